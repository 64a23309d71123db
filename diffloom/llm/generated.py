"""Generated, minified, vendored and bulk-data files among changed files.

Each file is tokenised once. Its identifier-masked tokens give its shape, its plain tokens its wording, and the
five-token shingles of both give MinHash signatures. Banded signatures form clusters of shapes and clusters of
wordings: components of links that are verified on the shingle sets at a similarity of 0.8 or more. The clusters decide:
wordings that span repositories are vendored, shapes whose words are literals are data, shapes with very many tokens a
line are minified, and families of one shape within a repository, most of whose members bear a mark of a generator, are
generated. Only what no cluster decides is left to the file's own marks and path.
"""

from __future__ import annotations

import re
import zlib
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from diffloom.operators.skew import dictionary_join, hot_keys
from diffloom.session import staged

SHINGLE = 5
SIMILAR = 0.8
BANDS, ROWS = 20, 8
#: Bands whose buckets are compared first where only components are asked for, so that most of the others needn't be.
FIRST_BANDS = 2
#: Shingles of one block of a bucket, and what each member weighs besides its own; blocks meet pairwise, in tiles.
BLOCK, MEMBER = 131_072, 128
#: Share of a family's files with a generator's mark from which all of them count as generated; the share of its whole
#: cluster weighs as FAMILY_PRIOR files in a repository's family, and CLUSTER_PRIOR unmarked files in that share keep
#: small clusters from deciding.
FAMILY_SHARE, FAMILY_PRIOR, CLUSTER_PRIOR = 0.6, 3, 3
#: Share of the files of its shapes that a cluster of wordings must hold to count as copied where no file name recurs:
#: texts of one style can be equal by chance, but then many others have the same shape.
OWN_SHAPE = 0.5
#: Numbers in a run without words from which they are bulk, length from which an unbroken string is, and the share of
#: such characters from which a shape is data.
BULK_RUN, BULK_STRING, BULK_SHARE = 36, 60, 0.2
#: Share of a shape's words (numbers, strings and names, without keys) that are literals from which it is data.
LITERAL_SHARE = 0.85
#: Tokens a line from which code is minified.
DENSE_LINE = 60
#: Files that are laid end to end at a time, and tokens a worker remembers.
_SLICE, _VOCABULARY = 256, 400_000
#: Words of 64 bits of all sets of a tile that are filled at a time.
_WORDS = 128

# Folders that hold copies of other projects, and files that list resolved dependencies or build output.
_VENDOR_PATH = re.compile(r"(?i)(?:^|/)(?:vendor|third[_-]?party|3rd[_-]?party|node_modules|bower_components|jspm_packages|external|extern|godeps|_workspace|site-packages|contrib/[\w.-]+-\d[\w.]*)/")
_LOCK_PATH = re.compile(r"(?i)(?:^|/)(?:[\w.-]+\.lock|[\w.-]*-lock\.(?:json|yaml|yml)|npm-shrinkwrap\.json|go\.sum|packages\.lock\.json|gradle\.lockfile|pnpm-lock\.yaml|bun\.lockb|flake\.lock)$")
_BUILT_PATH = re.compile(r"(?i)(?:^|/)dist/|\.min\.(?:js|css|mjs)$|\.bundle\.(?:js|css)$|\.(?:js|css|ts)\.map$|\.map$|\.snap$")
_CODE_PATH = re.compile(r"(?i)\.(?:jsx?|mjs|cjs|tsx?|css|py|java|go|rs|cs|kt|c|cc|cpp|h|rb|php|swift|scala)$")
_DOC_PATH = re.compile(r"(?i)\.(?:md|rst|txt|adoc|ya?ml|properties|toml|ini|cfg|env|pem)$")
# Header marks of generators, in several languages.
_GENERATED_MARK = re.compile(
    r"(?i)(?:^|\n)[^\w\n<@]{0,12}(?:(?:this )?(?:code|file|source|module) (?:is|was|has been)? ?(?:auto-?(?:matically)? ?)?generated\b|code generated by\b|@generated\b|<auto-generated|auto-?generated (?:file|code|by|on|from|source|content)|automatically generated\b"
    r"|generated (?:by|from|with|using) (?:\S+ ){0,4}(?:by \S+|v?\d[\d.]+|on |at )|generated by \S+[.\s]*(?:do not|\n)|machine[ -](?:written|generated|made)\b|(?:this file|the file|file) (?:was|is) (?:produced|created|written|emitted|built) by\b[^\n]*(?:manual|hand|edits?|overwritten|lost)"
    r"|(?:diese|die) datei wurde (?:automatisch|maschinell) (?:erzeugt|generiert|erstellt)|ce fichier (?:a été|est) (?:généré|produit)|(?:este|el) (?:archivo|fichero) (?:ha sido|fue|es|se ha) (?:generado|creado) auto|этот файл (?:создан|сгенерирован)|файл сгенерирован|(?:本|此|该)(?:文件|文档|代码)由?[^\n]{0,40}(?:自动|自動)?生成|(?:自动|自動)生成"
    r"|(?:do not|don't) (?:edit|modify)(?: by hand| manually| this file)?[.!; ]*(?:\*/)?\s*\n[^\n]*generated|generated[^\n]*[.,;!-]+ *(?:please )?(?:do not|don't|never) (?:edit|modify|change)\b(?! the))"
)
_EMITTED = re.compile(r"(?i)\b(?:emitted|generated|produced) by [\w.-]+,? (?:runtime )?version \d")
# Header marks of copies of other projects.
_VENDORED_MARK = re.compile(
    r"(?i)(?:^|\n)[^\w\n]{0,8}(?:(?:copied|vendored|taken|imported|adapted|mirrored|forked) (?:verbatim |unchanged )?from \S+(?: v?\d|[^\n]*(?:patches|upstream|https?:))|upstream(?: url| project)?: *\S+|[\w.-]+ v?\d+\.\d+(?:\.\d+)?\S*(?: *[|*-]+ *(?:\(c\)|©|copyright|https?:|license|licence|mit\b|released)|\n[^\n]*copyright)"
    r"|copyright (?:\(c\)|©)? ?[\d, -]*(?:by )?the [\w.-]+ (?:project|authors|contributors|developers|team)\b)|\| *\(c\) the [\w.-]+ contributors"
)
#: Comments, strings that stand as such, blank lines and directives from the top of a text, of whatever length.
_LEADING = re.compile(r"\A\ufeff?(?:\s+|//[^\n]*|\#[^\n]*|--[^\n]*|;[^\n]*|/\*[\s\S]*?(?:\*/|\Z)|<!--[\s\S]*?(?:-->|\Z)|\"\"\"[\s\S]*?(?:\"\"\"|\Z)|'''[\s\S]*?(?:'''|\Z)|<\?[^\n]*|['\"]use strict['\"];?)*")
_LOCK_TEXT = re.compile(r"\A\s*(?:\{\s*(?:\"name\"[^\n]*\n\s*)?(?:\"version\"[^\n]*\n\s*)?\"lockfileVersion\"|(?:#[^\n]*\n|\s)*\[\[package\]\]|lockfileVersion:|(?:#[^\n]*\n)*# yarn lockfile)")
_SOURCE_MAP = re.compile(r"\A\s*\{\s*\"version\"\s*:\s*3\s*,")
_MAP_LINK = re.compile(r"\n//# sourceMappingURL=\S+\s*\Z")
_TOKEN = re.compile(r"\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|//[^\n]*|/\*[\s\S]*?\*/|(?m:^\s*#[^\n]*)|[^\W\d]\w*|\d[\w.]*|[^\s\w]")
# Words that are not identifiers in the languages of the tables.
_KEYWORDS = set(
    "abstract as assert async await bool boolean break byte case catch char class const continue crate def default defer del do double elif else enum except export extends extern false finally float fn for from func function get go goto if impl implements import in "
    "instanceof int interface internal is lambda let long loop map match mod mut namespace new nil none None null number object of or and not override package pass private protected pub public raise range readonly record return sealed select self set short static string String "
    "struct super switch this throw throws trait true True False try type typeof union unsafe use using var virtual void where while with yield".split()
)
_CONSTANTS = {"true", "false", "True", "False", "null", "None", "nil"}
# Words without which no mark of a generator, or of a copy, can be there; in lower case.
_GENERATED_WORDS = ("generated", "machine", "produced", "created", "written", "emitted", "built", "erzeugt", "generiert", "erstellt", "généré", "produit", "generado", "creado", "создан", "сгенерир", "生成")
_VENDORED_WORDS = ("copied", "vendored", "taken", "imported", "adapted", "mirrored", "forked", "upstream", "copyright", "(c)", "©", "licen", " http", "|http", " mit", "|mit", "released")


def glob_pattern(globs: list[str]) -> str:
    """One regular expression, for paths with forward slashes, that matches any of ``globs``; case is ignored.

    ``**`` spans folders, ``*`` and ``?`` don't. No glob gives a pattern that matches nothing.
    """
    parts = []
    for g in globs:
        out, i = "", 0
        while i < len(g):
            if g.startswith("**/", i):
                out, i = out + "(?:.*/)?", i + 3
            elif g.startswith("**", i):
                out, i = out + ".*", i + 2
            elif g[i] in "*?":
                out, i = out + ("[^/]*" if g[i] == "*" else "[^/]"), i + 1
            else:
                out, i = out + re.escape(g[i]), i + 1
        parts.append(out)
    return r"(?is)\A(?:" + "|".join(parts) + r")\z" if parts else r"(?!)"


def _stem(path: str) -> str:
    """The file's name in lower case, without folders and extension."""
    return path.replace("\\", "/").rpartition("/")[2].partition(".")[0].lower()


def evidence(path: str, text: str) -> str | None:
    """What a file's path and marks tell by themselves: dependencies, vendored, built, generated, or None.

    Marks count anywhere in the text.
    """
    p = path.replace("\\", "/")
    if _LOCK_PATH.search(p) or _LOCK_TEXT.match(text):
        return "dependencies"
    if _VENDOR_PATH.search(p):
        return "vendored"
    if _BUILT_PATH.search(p) or _MAP_LINK.search(text) or _SOURCE_MAP.match(text) and '"mappings"' in text:
        return "built"
    text, low = text.replace("\r", ""), text.lower()
    if any(w in low for w in _GENERATED_WORDS) and (_GENERATED_MARK.search(text) or _EMITTED.search(text)):
        return "generated"
    if not _DOC_PATH.search(p) and any(w in low for w in _VENDORED_WORDS) and _VENDORED_MARK.search(text):
        return "vendored"
    return None


#: Kinds of tokens: signs, names, keywords, numbers, short strings, unbroken long strings, named constants.
_SIGN, _NAME, _KEYWORD, _NUMBER, _STRING, _BLOB, _CONSTANT = range(7)
_COLON, _BRACE, _COMMA = (1000 + ord(c) for c in ":{,")


class _Vocabulary(dict):
    """Token -> its row in the arrays ``raw`` and ``masked`` (codes), ``kind`` and ``size``; forgets all when full."""

    def __init__(self):
        super().__init__()
        self.raw, self.masked = np.zeros(_VOCABULARY, np.uint64), np.zeros(_VOCABULARY, np.uint64)
        self.kind, self.size = np.zeros(_VOCABULARY, np.int8), np.zeros(_VOCABULARY, np.int32)

    def room(self, n: int) -> None:
        """Make room for ``n`` new tokens."""
        if len(self) + n > len(self.raw):
            self.clear()
            if n > len(self.raw):
                for name in ("raw", "masked", "kind", "size"):
                    setattr(self, name, np.zeros(2 * n, getattr(self, name).dtype))

    def __missing__(self, t: str) -> int:
        c, i = t[0], len(self)
        if c in "\"'" and len(t) > 1:
            kind, masked = (_BLOB, 4) if len(t) > BULK_STRING and not any(map(str.isspace, t)) else (_STRING, 3)
        elif c.isdigit():
            kind, masked = _NUMBER, 2
        elif c == "_" or c.isalpha():
            kind = _CONSTANT if t in _CONSTANTS else _KEYWORD if t in _KEYWORDS else _NAME
            masked = zlib.crc32(t.encode()) if t in _KEYWORDS else 1
        else:
            kind, masked = _SIGN, 1000 + ord(c)
        self.raw[i], self.masked[i], self.kind[i], self.size[i] = zlib.crc32(t.encode("utf-8", "replace")), masked, kind, len(t)
        self[t] = i
        return i


def tokens(text: str) -> list[str]:
    """The tokens of a text, without comments."""
    return [x for x in _TOKEN.findall(text) if x[0] not in "/#" and not x[0].isspace() or x == "/"]


def laid_out(toks: list[list[str]], vocabulary: _Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """The rows of the tokens of texts laid end to end, and the number of tokens of each text."""
    lengths = np.fromiter(map(len, toks), np.int64, len(toks))
    vocabulary.room(int(lengths.sum()))
    return np.fromiter(map(vocabulary.__getitem__, chain.from_iterable(toks)), np.int64, int(lengths.sum())), lengths


def _mixed(h: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
        return h ^ (h >> np.uint64(29))


def shingles(codes: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """32-bit hashes of the runs of SHINGLE codes within each text, and where each text's begin.

    A text with fewer codes has one shingle, of what there is; every length must be above 0.
    """
    short = np.maximum(SHINGLE - lengths, 0)
    if short.any():
        codes = np.insert(codes, np.repeat(np.cumsum(lengths), short), np.uint64(0))
        lengths = lengths + short
    n = len(codes) - SHINGLE + 1
    h = np.zeros(n, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for j in range(SHINGLE):
            h = _mixed(h + codes[j : j + n])
    ends, keep = np.cumsum(lengths), np.ones(n, dtype=bool)
    for j in range(1, SHINGLE):  # shingles that reach into the next text
        keep[(ends - j)[ends - j < n]] = False
    return (h[keep] >> np.uint64(32)).astype(np.uint32), np.concatenate(([0], np.cumsum(lengths - SHINGLE + 1)[:-1]))


def _permutations(n: int) -> tuple[np.ndarray, np.ndarray]:
    r = np.random.default_rng(20240117)
    return r.integers(1, 2**32, n, dtype=np.uint32) | np.uint32(1), r.integers(0, 2**32, n, dtype=np.uint32)


def signatures(codes: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """MinHash signatures (texts x BANDS * ROWS), cut to 8 bits a place; a band's places are its key."""
    h, starts = shingles(codes, lengths)
    with np.errstate(over="ignore"):
        low = np.stack([np.minimum.reduceat(h * a + b, starts) for a, b in zip(*_permutations(BANDS * ROWS))], axis=1)
    return (low ^ (low >> np.uint32(11)) ^ (low >> np.uint32(22))).astype(np.uint8)


def sequence_hashes(codes: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each text's whole sequence of codes; every length must be above 0."""
    starts = np.cumsum(lengths) - lengths
    place = (np.arange(len(codes)) - np.repeat(starts, lengths)).astype(np.uint64)
    with np.errstate(over="ignore"):
        h = np.add.reduceat(_mixed(codes + _mixed(place + np.uint64(7)) * np.uint64(3)), starts)
        return _mixed(h + lengths.astype(np.uint64)).view(np.int64)


def token_counts(at: np.ndarray, lengths: np.ndarray, v: _Vocabulary) -> np.ndarray:
    """(literals, words, characters, bulk characters) of each text; every length must be above 0.

    A name before a colon that is a key counts as no word.
    """
    starts = np.cumsum(lengths) - lengths
    kind, masked, size = v.kind[at], v.masked[at], v.size[at]
    after, before = np.roll(masked, -1), np.roll(masked, 1)
    after[starts + lengths - 1] = before[starts] = 0
    literal = kind >= _NUMBER
    key = (after == _COLON) & ((before == _BRACE) | (before == _COMMA))
    word = literal | ((kind == _NAME) | (kind == _KEYWORD)) & ~key
    stop = np.isin(kind, (_NAME, _KEYWORD, _STRING, _CONSTANT))
    stop[starts] = True
    run = np.cumsum(stop) - 1
    bulk = (kind == _NUMBER) & (np.bincount(run, kind == _NUMBER)[run] >= BULK_RUN) | (kind == _BLOB)
    return np.stack([np.add.reduceat(x.astype(np.int64), starts) for x in (literal, word, size, size * bulk)], axis=1)


_COUNTS = ("tokens", "lines", "literals", "words", "size", "bulk")
_SCHEMA = "file_id bigint, repo string, stem bigint, label string, code boolean, shape bigint, wording bigint, shape_signature binary, wording_signature binary, " + ", ".join(f"{c} bigint" for c in _COUNTS)


def described(files: DataFrame) -> DataFrame:
    """Every file with text by its label (direct evidence), its shape and wording (hashes), signatures and counts.

    Signatures of a shape are given where a worker first meets it; a text without tokens (comments only) has neither
    shape nor wording.
    """

    def run(batches):
        v, seen, names = _Vocabulary(), set(), [f.split()[0] for f in _SCHEMA.split(", ")]
        for batch in batches:
            for lo in range(0, batch.num_rows, _SLICE):
                b = batch.slice(lo, _SLICE)
                globbed, paths, texts = (b.column(i).to_pylist() for i in (2, 3, 4))
                paths = [p or "" for p in paths]
                label = ["generated" if g else evidence(p, t) for g, p, t in zip(globbed, paths, texts)]
                lines = [max(1, sum(1 for x in t[_LEADING.match(t).end() :].splitlines() if x.strip())) for t in texts]
                toks = [tokens(t) for t in texts]
                at, lengths = laid_out(toks, v)
                some = np.flatnonzero(lengths)
                out = {c: np.zeros(len(texts), np.int64) for c in ("shape", "wording", *_COUNTS)}
                sig = {c: np.full(len(texts), None, object) for c in ("shape", "wording")}
                out["tokens"], out["lines"] = lengths, np.array(lines)
                if len(some):
                    full = lengths[some]
                    for name, code in (("shape", v.masked[at]), ("wording", v.raw[at])):
                        out[name][some] = sequence_hashes(code, full)
                        sig[name][some] = [x.tobytes() for x in signatures(code, full)]
                    for name, x in zip(_COUNTS[2:], token_counts(at, full, v).T):
                        out[name][some] = x
                for i in some:
                    if out["shape"][i] in seen:
                        sig["shape"][i] = None
                    seen.add(out["shape"][i])
                if len(seen) > 2_000_000:
                    seen.clear()
                none = lengths == 0
                stems = pa.array([zlib.crc32(_stem(p).encode("utf-8", "replace")) for p in paths], pa.int64())
                code = pa.array([bool(_CODE_PATH.search(p)) for p in paths], pa.bool_())
                cols = [b.column(0), b.column(1), stems, pa.array(label, pa.string()), code]
                cols += [pa.array(out[c], pa.int64(), mask=none) for c in ("shape", "wording")] + [pa.array(sig[c], pa.binary()) for c in ("shape", "wording")]
                yield pa.RecordBatch.from_arrays(cols + [pa.array(out[c], pa.int64()) for c in _COUNTS], names=names)

    return files.mapInArrow(run, _SCHEMA)


def shingle_sets(texts: DataFrame, which: str) -> DataFrame:
    """(class, shingles) from (class, content): the distinct shingle hashes of each text, in order; which: shape or wording."""

    def run(batches):
        v = _Vocabulary()
        for batch in batches:
            for lo in range(0, batch.num_rows, _SLICE):
                b = batch.slice(lo, _SLICE)
                at, lengths = laid_out([tokens(t) for t in b.column(1).to_pylist()], v)
                h, starts = shingles((v.masked if which == "shape" else v.raw)[at], lengths)
                sets = [np.unique(x).tobytes() for x in np.split(h, starts[1:])]
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sets, pa.binary())], names=["class", "shingles"])

    return texts.select("class", "content").mapInArrow(run, "class bigint, shingles binary")


def _bits(sets: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The sets as rows of bits, for those shingles that more than one of them has, and the size of each set."""
    sizes = np.fromiter(map(len, sets), np.int64, len(sets)) // 4
    _, place, n = np.unique(np.frombuffer(b"".join(sets), dtype=np.uint32), return_inverse=True, return_counts=True)
    many = n > 1
    kept = many[place]
    owner, place = np.repeat(np.arange(len(sets)), sizes)[kept], (np.cumsum(many) - 1)[place[kept]]
    bits = np.zeros((len(sets), -(-int(many.sum()) // 64)), np.uint64)
    for lo in range(0, bits.shape[1], _WORDS):
        part, width = (place >= 64 * lo) & (place < 64 * (lo + _WORDS)), min(_WORDS, bits.shape[1] - lo)
        flags = np.zeros((len(sets), 64 * width), bool)
        flags[owner[part], place[part] - 64 * lo] = True
        bits[:, lo : lo + width] = np.packbits(flags, axis=1).view(np.uint64)
    return bits, sizes


def near_pairs(sets: list[bytes], side: np.ndarray, component: np.ndarray, every: bool) -> list[tuple[int, int]]:
    """The pairs of places in ``sets`` whose similarity is SIMILAR or more: all pairs, or those of different sides if there are two.

    With ``every`` unset only pairs of different components are compared, and a pair that is found joins its components.
    """
    bits, sizes = _bits(sets)
    here, there = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    label, out = component.copy(), []
    for k, r in enumerate(here):
        to = there if len(there) else here[k + 1 :]
        if not every:
            to = to[label[to] != label[r]]
        to = to[np.minimum(sizes[to], sizes[r]) / np.maximum(sizes[to], sizes[r]) >= SIMILAR]
        if not len(to):
            continue
        both = np.bitwise_count(bits[to] & bits[r]).sum(axis=1, dtype=np.int64)
        to = to[both / (sizes[to] + sizes[r] - both) >= SIMILAR]
        if not every:
            to = to[np.unique(label[to], return_index=True)[1]]
            label[np.isin(label, label[to])] = label[r]
        out += [(r, x) for x in to]
    return out


def linked(tiles: DataFrame, every: bool) -> DataFrame:
    """(class, other) of the ``near_pairs`` of each tile: rows of equal (key, i, j) in (key, i, j, side, class, component, shingles)."""

    def run(batches):
        held = None
        for batch in chain(batches, [None]):
            t = held if batch is None else pa.Table.from_batches([batch] if held is None else [*held.to_batches(), batch])
            if t is None or not t.num_rows:
                continue
            key, i, j, side, own, component = (t.column(c).to_numpy() for c in range(6))
            starts = np.concatenate(([0], 1 + np.flatnonzero((np.diff(key) != 0) | (np.diff(i) != 0) | (np.diff(j) != 0)), [t.num_rows]))
            if batch is not None:  # the last tile may go on in the next batch
                held, starts = t.slice(starts[-2]), starts[:-1]
            found = []
            for lo, hi in zip(starts[:-1], starts[1:]):
                if hi - lo > 1 and (i[lo] == j[lo] or side[lo:hi].any() and not side[lo:hi].all()):
                    found += [(own[lo + x], own[lo + y]) for x, y in near_pairs(t.column(6).slice(lo, hi - lo).to_pylist(), side[lo:hi], component[lo:hi], every)]
            pairs = np.sort(np.array(found, np.int64).reshape(-1, 2), axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["class", "other"])

    rows = tiles.select("key", "i", "j", "side", "class", "component", "shingles")
    return rows.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j").mapInArrow(run, "class bigint, other bigint")


def components(links: DataFrame) -> DataFrame:
    """(class, component) of every class in ``links`` (class, other): the least class that it is joined with.

    Each round every class moves to its least neighbour, and on to where that one moves; then the links are taken over
    by the classes moved to, and those within one class go. Links shrink from round to round until none is left.
    """
    both = links.unionByName(links.select(F.col("other").alias("class"), F.col("class").alias("other")))
    edges = staged(both.distinct(), "edges")
    labels = edges.select("class", F.col("class").alias("component")).distinct()
    while True:
        up = staged(edges.groupBy("class").agg(F.min("other").alias("up")).where("up < class"), "up")
        for _ in range(2):
            up = up.join(up.withColumnsRenamed({"up": "top", "class": "up"}), "up", "left").select("class", F.coalesce("top", "up").alias("up"))
        up = staged(up, "up")
        labels = labels.join(up.withColumnRenamed("class", "component"), "component", "left").select("class", F.coalesce("up", "component").alias("component"))
        moved = edges.join(up, "class", "left").select(F.coalesce("up", "class").alias("class"), "other")
        moved = moved.join(up.withColumnRenamed("class", "other"), "other", "left").select("class", F.coalesce("up", "other").alias("other"))
        edges = staged(moved.where("class <> other").distinct(), "edges")
        if edges.isEmpty():
            return staged(labels, "labels")


def clusters(classes: DataFrame, contents: DataFrame, which: str, every: bool = True) -> tuple[DataFrame, DataFrame]:
    """(class, head, component) of ``classes`` (class, file_id, signature), and the verified links (head, other) of heads.

    Classes of equal shingle sets have one head; a head without links is a component by itself.

    Classes with equal bands share a bucket. Within it all pairs are compared on their shingle sets, and those that are
    SIMILAR are linked; with ``every`` unset, only pairs that aren't in one component yet are compared, and the links
    are as many as join the components. A bucket of many shingles is dealt to blocks, and each two blocks meet in a tile,
    so no task holds a whole bucket.
    """
    at = F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda i: F.substring("signature", i * ROWS + 1, F.lit(ROWS)))).alias("band", "part")
    rows = classes.select("class", at).select("class", "band", F.xxhash64("band", "part").alias("key"))
    shared = staged(rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "buckets")
    crowded = hot_keys(shared, "key", "n", shared.agg(F.sum("n")).first()[0] or 0)
    members = staged(dictionary_join(rows, shared.select("key"), "key", "class", crowded), "members")
    needed = staged(members.select("class").distinct().join(classes.select("class", "file_id"), "class"), "needed")
    sets = staged(shingle_sets(contents.join(needed, "file_id").dropDuplicates(["class"]), which), "sets")
    alike = sets.select("class", F.xxhash64("shingles").alias("like"), (F.length("shingles") / 4).cast("long").alias("size"))
    first = alike.groupBy("like").agg(F.min("class").alias("head"))
    alike = staged(alike.join(first, "like").select("class", "head", "size"), "alike")  # equal sets are one from the start
    labels = alike.where("class = head").select("head", "size", F.col("head").alias("component"))
    members = members.join(alike.select("class", "head"), "class").select("head", "band", "key").distinct()
    members, all_links = staged(members, "members"), None
    for lo, hi in [(0, BANDS)] if every else [(0, FIRST_BANDS), (FIRST_BANDS, BANDS)]:
        placed = staged(members.where(F.col("band").between(lo, hi - 1)).join(labels, "head"), "placed")
        blocks = F.ceil(F.sum(F.col("size") + MEMBER) / BLOCK).alias("blocks")
        split = placed.groupBy("key").agg(blocks, F.min("component").alias("a"), F.max("component").alias("b")).where("a <> b").select("key", "blocks")
        met = dictionary_join(placed, split, "key", "head", crowded).withColumn("own", F.pmod(F.xxhash64("head", F.lit(lo)), "blocks"))
        met = met.withColumn("with", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
        i, j = F.least("own", "with"), F.greatest("own", "with")
        met = met.select("key", i.alias("i"), j.alias("j"), (F.col("own") > F.col("with")).cast("int").alias("side"), F.col("head").alias("class"), "component")
        near = staged(linked(met.join(sets, "class"), every).distinct(), "links")
        own, theirs = labels.select(F.col("head").alias("class"), F.col("component").alias("a")), labels.select(F.col("head").alias("other"), F.col("component").alias("b"))
        joined = components(near.join(own, "class").join(theirs, "other").select(F.col("a").alias("class"), F.col("b").alias("other")))
        joined = joined.select(F.col("component").alias("to"), F.col("class").alias("component"))
        labels = staged(labels.join(joined, "component", "left").select("head", "size", F.coalesce("to", "component").alias("component")), "clusters")
        all_links = near if all_links is None else all_links.unionByName(near)
    of = alike.join(labels, "head").select("class", "head", "component")
    whole = classes.select("class").join(of, "class", "left").select("class", F.coalesce("head", "class").alias("head"), F.coalesce("component", "class").alias("component"))
    return whole, all_links.withColumnRenamed("class", "head")


_EMITTED_LABELS = ("generated", "built", "dependencies")


def _by_class(files: DataFrame, which: str, *keys: str) -> DataFrame:
    """Counts of the files with text per class and ``keys``."""
    return (
        files.where(F.col(which).isNotNull())
        .groupBy(F.col(which).alias("class"), *keys)
        .agg(
            F.min("file_id").alias("file_id"),
            F.min(f"{which}_signature").alias("signature"),
            F.count(F.lit(1)).alias("files"),
            F.count_if(F.col("label").isin(*_EMITTED_LABELS)).alias("emitted"),
            F.count_if(F.col("label") == "vendored").alias("vendored"),
            F.count_if("code").alias("code"),
            *(F.sum(F.when(F.col("code"), F.col(c)).otherwise(0)).alias(c) for c in _COUNTS),
        )
    )


def _summed(df: DataFrame, key: str, *columns: str) -> DataFrame:
    return df.groupBy(key).agg(*(F.sum(c).alias(c) for c in columns))


def shape_verdicts(files: DataFrame, contents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(class, reason) of shapes that are data or minified, and (class, repo) of shapes that are generated in a repository.

    A shape is data by the literals of its files, and minified by the tokens a line of its component; both are counted in
    code only. A component's files within one repository are a family: generated if the share of members with a
    mark of a generator, smoothed by that of the whole component, reaches FAMILY_SHARE.
    """
    by_repo = staged(_by_class(files, "shape", "repo"), "shapes-by-repository")
    classes = by_repo.groupBy("class").agg(F.min("file_id").alias("file_id"), F.min("signature").alias("signature"), *(F.sum(c).alias(c) for c in ("files", "emitted", "code", *_COUNTS)))
    classes = staged(classes, "shapes")
    whole = clusters(classes, contents, "shape", every=False)[0]
    literal = (F.col("bulk") >= BULK_SHARE * F.col("size")) | (F.col("literals") >= LITERAL_SHARE * F.col("words"))
    data, dense = (F.col("words") > 0) & literal, F.col("tokens") >= DENSE_LINE * F.col("lines")
    placed = classes.join(whole, "class")
    sums = _summed(placed, "component", "files", "emitted", "code", "tokens", "lines").select("component", "files", "emitted", ((F.col("code") > 0) & dense).alias("dense"))
    sums = staged(sums, "shape-clusters")
    own = F.when((F.col("code") > 0) & data, "data").when(F.col("dense"), "minified")
    literals = placed.join(sums.select("component", "dense"), "component").select("class", own.alias("reason")).where("reason IS NOT NULL")
    share = F.col("emitted") / (F.col("files") + CLUSTER_PRIOR)
    homes = by_repo.join(whole, "class").select("class", "component", "repo", "files", "emitted")
    family = homes.groupBy("component", "repo").agg(F.sum("files").alias("n"), F.sum("emitted").alias("g")).join(sums.select("component", share.alias("share")), "component")
    family = family.where((F.col("g") + FAMILY_PRIOR * F.col("share")) >= FAMILY_SHARE * (F.col("n") + FAMILY_PRIOR)).select("component", "repo")
    return literals, homes.join(family, ["component", "repo"], "left_semi").select("class", "repo")


def copied_wordings(files: DataFrame, contents: DataFrame) -> DataFrame:
    """(class, stem) of wordings of code that are copies of something that is kept elsewhere too.

    A head and the heads linked to it make a star. All of a star that spans repositories are copies if it makes up
    OWN_SHAPE of all files of its shapes, so that chance can't explain it, or if it is mostly vendored by path or mark.
    Apart from that, files of one component that bear the same name in several repositories are.
    """
    code = files.where("code AND wording IS NOT NULL")
    classes = staged(code.groupBy(F.col("wording").alias("class")).agg(F.min("file_id").alias("file_id"), F.min("wording_signature").alias("signature")), "wordings")
    whole, links = clusters(classes, contents, "wording")
    ends = (F.min("a").alias("a"), F.max("b").alias("b"))
    per = code.groupBy(F.col("wording").alias("class"), "shape", "stem").agg(F.min("repo").alias("a"), F.max("repo").alias("b"), F.count(F.lit(1)).alias("files"), F.count_if(F.col("label") == "vendored").alias("vendored"))
    per = staged(per.join(whole, "class"), "wordings-by-name")
    heads = per.groupBy("head").agg(*ends, F.sum("files").alias("files"), F.sum("vendored").alias("vendored"), F.collect_set("shape").alias("shapes"))
    heads = staged(heads, "heads")
    itself = heads.select("head", F.col("head").alias("other"))
    star = staged(links.unionByName(links.select(F.col("other").alias("head"), F.col("head").alias("other"))).unionByName(itself).distinct(), "stars")
    often = hot_keys(star.groupBy("other").agg(F.count(F.lit(1)).alias("n")), "other", "n", star.count())
    met = dictionary_join(star, heads.withColumnRenamed("head", "other"), "other", "head", often)
    spans = met.groupBy("head").agg(*ends, F.sum("files").alias("files"), F.sum("vendored").alias("vendored")).where("files > 1 AND (a <> b OR vendored > 0)")
    shapes = code.groupBy("shape").agg(F.count(F.lit(1)).alias("of"))
    room = met.select("head", F.explode("shapes").alias("shape")).distinct().join(spans.select("head"), "head", "left_semi").join(shapes, "shape").groupBy("head").agg(F.sum("of").alias("of"))
    own_shape = (F.col("a") != F.col("b")) & (F.col("files") >= OWN_SHAPE * (F.col("of") + 1))
    copied = spans.join(room, "head").where(own_shape | (2 * F.col("vendored") > F.col("files"))).select("head")
    copied = star.join(copied, "head", "left_semi").select(F.col("other").alias("head")).distinct()
    recurs = per.groupBy("component", "stem").agg(*ends).where("a <> b").select("component", "stem")
    named = per.join(recurs, ["component", "stem"], "left_semi").select("class", "stem")
    return per.join(copied, "head", "left_semi").select("class", "stem").unionByName(named).distinct()


def unwritten_files(files: DataFrame, options: DataFrame) -> DataFrame:
    """(file_id, reason): every changed file that nobody wrote by hand.

    Reasons by clusters: copy, data, minified, family; by the file alone, where no cluster decides: generated,
    dependencies, built, vendored. Files without text (null or blank) are never in the result, whatever their path. Null
    repositories count as one; repeated file ids count once, with the first reason in the order above; an empty table
    gives an empty result.
    """
    globs = [r["pattern"] for r in options.where("field_name = 'generated_globs'").select("pattern").distinct().collect()]
    globbed = F.coalesce(F.translate("path", "\\", "/").rlike(glob_pattern(globs)), F.lit(False))
    base = files.select(F.col("file_id").cast("long").alias("file_id"), F.coalesce("repo", F.lit("")).alias("repo"), globbed.alias("globbed"), "path", "content").where(F.col("content").rlike(r"\S"))
    described_ = staged(described(base), "files")
    contents = base.select("file_id", "content")
    literals, families = shape_verdicts(described_, contents)
    copies = copied_wordings(described_, contents)
    crowd = lambda c, name: hot_keys(described_.groupBy(c.alias(name)).agg(F.count(F.lit(1)).alias("n")), name, "n", total)
    total = described_.count()
    named, home = F.xxhash64("wording", "stem"), F.xxhash64("shape", "repo")
    out = described_.select("file_id", "label", "code", "shape", named.alias("named"), home.alias("home"))
    copies = staged(copies.select(F.xxhash64("class", "stem").alias("named"), F.lit("copy").alias("copy")), "copies")
    out = dictionary_join(out, copies, "named", "file_id", crowd(named, "named"), "left")
    out = dictionary_join(out, staged(literals.withColumnsRenamed({"class": "shape", "reason": "literals"}), "literals"), "shape", "file_id", crowd(F.col("shape"), "shape"), "left")
    families = staged(families.select(F.xxhash64("class", "repo").alias("home"), F.lit("family").alias("family")), "family-homes")
    out = dictionary_join(out, families, "home", "file_id", crowd(home, "home"), "left")
    by_code = lambda c: F.when(F.col("code"), F.col(c))
    reason = F.coalesce(by_code("copy"), by_code("literals"), "family", "label")
    order = F.array(*(F.lit(x) for x in ("copy", "data", "minified", "family", "generated", "dependencies", "built", "vendored")))
    return out.select("file_id", reason.alias("reason")).where("reason IS NOT NULL").groupBy("file_id").agg(F.min_by("reason", F.array_position(order, F.col("reason"))).alias("reason"))
