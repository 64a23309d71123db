"""Credentials embedded in source lines: find them, check their structure, and redact them in place.

A keyword automaton runs over each unit once and names the lines worth a closer look. Issuer formats, addresses,
headers, command lines, calls and assignments are then matched on those lines, validated (checksums, token structure,
placeholders, references, digests), and replaced by placeholders of the same length and alphabet.
"""

from __future__ import annotations

import base64
import binascii
import json
import re
import zlib

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from diffloom.operators.gate import detected_language
from diffloom.session import staged

# Names that stand for a secret, in one word or in two with a joint or none between them.
_NAMES = ("pass", "password", "passwd", "passphrase", "passcode", "pwd", "secret", "token", "credential", "credentials", "auth", "jwt", "bearer", "psk")
_NAMES_OF_TWO = (("api", "key"), ("access", "key"), ("private", "key"), ("sign", "key"), ("signing", "key"), ("encrypt", "key"), ("encryption", "key"), ("secret", "key"), ("master", "key"), ("account", "key"), ("shared", "key"), ("auth", "key"), ("hmac", "key"), ("pin", "code"), ("secret", "value"))
# How the tokens of issuers begin.
_BEGINNINGS = "AKIA ASIA ghp_ gho_ ghu_ ghs_ ghr_ github_pat_ glpat- glptt- gldt- glrt- glsoat- xoxa- xoxb- xoxe- xoxo- xoxp- xoxr- xoxs- xapp- npm_ sk_live_ sk_test_ rk_live_ rk_test_ sk- AIza SG. hf_ dop_v1_ shpat_ pypi- whsec_ eyJ".split()
# What else a line with an address, a header, an option, a call, a comment or a private key holds.
_SIGNS = ("://", "server=", "sharedaccesskey", "sig=", "basic", "authorization", "x-api-key", "login", "log_in", "signin", "sign_in", "connect", "-u ", "-u\t", "--user", " pw ", "pw:", "pw=", "pw is", "key:", "key=", "key =", "key is", "key was", "key ->", "begin ")
#: Keywords whose lines are looked at, in lower case; they follow from the patterns, so that no pattern is out of reach.
KEYWORDS = sorted({*_NAMES, *(a + joint + b for a, b in _NAMES_OF_TWO for joint in ("", "_", "-", ".", " ")), *(x.lower() for x in _BEGINNINGS), *_SIGNS})

# Token formats of issuers.
_ISSUERS = {
    "aws-key": r"(?<![A-Za-z0-9])(?:AKIA|ASIA)[A-Z0-9]{16}(?![A-Za-z0-9])",
    "github-token": r"(?<![A-Za-z0-9])gh[pousr]_[A-Za-z0-9]{36,255}(?![A-Za-z0-9])",
    "github-pat": r"(?<![A-Za-z0-9])github_pat_[A-Za-z0-9]{20,24}_[A-Za-z0-9]{40,70}(?![A-Za-z0-9])",
    "gitlab-token": r"(?<![A-Za-z0-9])gl(?:pat|ptt|dt|rt|soat)-[A-Za-z0-9_\-]{20,64}(?![A-Za-z0-9_\-])",
    "slack-token": r"(?<![A-Za-z0-9])xox[abeoprs]-(?:[0-9]{6,14}-)*[A-Za-z0-9\-]{10,72}(?![A-Za-z0-9])",
    "npm-token": r"(?<![A-Za-z0-9])npm_[A-Za-z0-9]{36}(?![A-Za-z0-9])",
    "stripe-key": r"(?<![A-Za-z0-9])[sr]k_(?:live|test)_[A-Za-z0-9]{16,99}(?![A-Za-z0-9])",
    "api-key": r"(?<![A-Za-z0-9])sk-(?:proj-|ant-)?[A-Za-z0-9_\-]{20,200}(?![A-Za-z0-9])",
    "google-key": r"(?<![A-Za-z0-9])AIza[A-Za-z0-9_\-]{35}(?![A-Za-z0-9_\-])",
    "mail-key": r"(?<![A-Za-z0-9])SG\.[A-Za-z0-9_\-]{16,32}\.[A-Za-z0-9_\-]{32,64}(?![A-Za-z0-9_\-])",
    "hub-token": r"(?<![A-Za-z0-9])(?:hf_[A-Za-z0-9]{30,40}|dop_v1_[a-f0-9]{64}|shpat_[a-fA-F0-9]{32}|pypi-[A-Za-z0-9_\-]{50,}|whsec_[A-Za-z0-9+/=]{24,})(?![A-Za-z0-9_\-])",
    "jwt": r"(?<![A-Za-z0-9])eyJ[A-Za-z0-9_\-]{8,}\.eyJ[A-Za-z0-9_\-]{4,}\.[A-Za-z0-9_\-]{16,}(?![A-Za-z0-9_\-])",
}
_ISSUER = re.compile("|".join(f"(?P<{k.replace('-', '_')}>{v})" for k, v in _ISSUERS.items()))

#: A name stands for a secret if it ends in one of these, whatever its case and joints.
_SECRET_NAME = re.compile(r"(?i)(?:%s|%s|access[_\-.]?key[_\-.]?id)$" % ("|".join(_NAMES), "|".join(rf"{a}[_\-.]?{b}" for a, b in _NAMES_OF_TWO)))
_PUBLIC_NAME = re.compile(r"public|(?:^|[_\-.])(?:max|min|num|count|next[_\-.]?page|page|csrf|cancellation|cancel|pagination)[_\-.]?token$", re.I)
# What stands for a value instead of being one.
_PLACEHOLDER = re.compile(
    r"(?i)\A(?:x+|\*+|\.+|-+|_+|#+|0+|todo|tbd|fixme|none|null|nil|true|false|undefined|changeme|change[_\- ]?me|change[_\- ]?it|replace[_\- ]?(?:me|this)|redacted|removed|withheld|hidden|masked|secret|password|passwd|token"
    r"|dummy|sample|placeholder|example|test|testing|foo|bar|foobar|username|user|insert[_\- ].*|enter[_\- ].*|(?:your|my|some|the)[_\- ].*|.*[_\- ]here|.*(?:placeholder|redacted|changeme|replace[_\- ]?me|dummy|example(?:only)?)\W*.*)\Z"
)
_REFERENCE = re.compile(
    r"\A(?:<[^<>]*>|\[[^\[\]]*\]|\$\{.*\}|\$\(.*\)|\$[A-Za-z_]\w*|%[A-Za-z_]\w*%|%\(\w+\)s|%[sdv]|\{\{.*\}\}|\{\w*\}|#\{.*\}|@\w+@|__\w+__|!\w.*|(?i:env|vault|file|secret|ssm|kms|sops|keyvault|aws-sm|op|ref|config|keyring|arn)(?:://|:).*"
    r"|/run/secrets/.*|/(?:etc|var|run|opt|home|mnt|secrets?)/.*|\./.*|~/.*)\Z"
)
_TEXTUAL = re.compile(r"\A[A-Za-z][a-z']*(?: [A-Za-z'()\-.,:;!?]+)+[.!?:]?\s*\Z")
_UUID = re.compile(r"(?i)\A[0-9a-f]{8}-(?:[0-9a-f]{4}-){3}[0-9a-f]{12}\Z")
_DIGEST = re.compile(r"(?i)\A(?:sha(?:1|224|256|384|512)|md5)[-:=].+\Z")

_STRING = r"(?:\"((?:[^\"\\\n]|\\.)*)\"|'((?:[^'\\\n]|\\.)*)'|`((?:[^`\\\n]|\\.)*)`)"
_NAME = r"[A-Za-z_$][\w$.\-]*"
_NAMED = (
    # name = "v", name: "v", "name": "v", name => "v", m["name"] = "v", const name: &str = "v", <T> name = "v"
    re.compile(rf"[\"'`]?({_NAME})[\"'`]?\s*\]?\s*(?::\s*(?:&?(?:'\w+ )?[A-Za-z_][\w.<>\[\]? |]*)?\s*=|:=|=>|=|:)\s*(?:new\s+\w+\(|\(\s*|String\.raw\s*|[rbfu]{{1,2}}(?=[\"'])|@(?=\"))?{_STRING}"),
    # f("name", "v")
    re.compile(rf"\(\s*[\"']({_NAME})[\"']\s*,\s*{_STRING}"),
    # <name>v</name> and name="v" inside a tag are covered by the first; this is the element form
    re.compile(r"<(\w[\w.\-]*)>()()([^<>\s][^<>\n]*)</\1>"),
)
_BARE = re.compile(rf"^\s*(?:[#;]\s*|//\s*|-\s+)?(?:export\s+|set\s+|ENV\s+|ARG\s+|-D)?[\"']?({_NAME})[\"']?\s*(?:=|:\s)\s*([^\s\"'`({{\[<|>&,;][^\s\"'`;,]*)\s*[,;]?\s*(?:#.*)?$")
_OPEN = re.compile(rf"[\"'`]?({_NAME})[\"'`]?\s*\]?\s*(?::\s*(?:&?(?:'\w+ )?[A-Za-z_][\w.<>]*)?\s*=|:=|=>|=|:)\s*(?:\(|\\|[|>][-+]?|\"\"\"|'''|`)?\s*$")
_OPEN_CALL = re.compile(rf"\(\s*[\"']({_NAME})[\"']\s*,\s*$")
_FIRST_STRING = re.compile(rf"^\s*[\"+.(]*\s*{_STRING}")
_FIRST_BARE = re.compile(r"^\s*([^\s\"'`]{8,})\s*$")
_URL = re.compile(r"[a-zA-Z][a-zA-Z0-9+.\-]*://([^\s:/@\"'`<>]*):([^\s\"'`/<>]+?)@(?=[\w\[$.{%-])")
_PAIRS = re.compile(r"(?i)[;\"'`?&](?:password|pwd|accountkey|sharedaccesskey|sharedsecret|client_secret|access_token|api_key|sig)=([^;\"'`\s&()]+)")
_HEADER = re.compile(r"(?i)\b(?:authorization|proxy-authorization)\b[\"']?\s*[:=,]\s*[\"']?(bearer|basic|token|apikey)\s+([^\s\"'`,;]+)|\b(bearer|basic)\s+([A-Za-z0-9+/=_.\-]{12,})|\b(?:x-api-key|x-auth-token|private-token|api-key)\b[\"']?\s*[:=,]\s*[\"']?([^\s\"'`,;]+)")
_OPTION = re.compile(r"(?i)(?:^|[\s\"'(])--?(?:password|passwd|pass|pwd|token|secret|api-key|apikey|access-token|auth-token|client-secret|passphrase)(?:\s+|=)([^\s\"'`]+)|(?:\s|[\"'])(?:-u|--user)\s+[\w.\-]+:([^\s\"'`]+)")
_CALL = re.compile(rf"(?i)(?:\b|\.|_)(?:connect|login|log_in|signin|sign_in|authenticate|auth|setbasicauth|basicauth|basic_auth|httpbasicauth|networkcredential|usernamepasswordcredentials|passwordauthentication|credentials?|setcredentials|getconnection|createconnection)\s*\(\s*(?:[^\"'`()]*,\s*)?{_STRING}\s*,\s*(?:[a-z_]+\s*=\s*)?{_STRING}")
_SPOKEN = re.compile(r"(?i)\b(?:pass(?:word|wd|phrase|code)|pwd|pw|secret|token|api[ _\-]?key|access[ _\-]?key|signing[ _\-]?key|encryption[ _\-]?key|credentials?|key)\b\s*(?:for \w+ |of \w+ )?(?:is|was|were|set to|now|=|:|->|to)?\s*[\"'`(]?([^\s\"'`,;()]{8,})")
_COMMENT = re.compile(r"(?:^|\s)(?://|#|--|/\*|\*|;|<!--)\s*(.*)$|(?i:[\"']?\b(?:comment|note|description|remark|todo)s?[\"']?\s*[:=]\s*)(.*)$")
_PRIVATE = re.compile(r"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----")
_PEM_END = re.compile(r"-----END [A-Z0-9 ]*PRIVATE KEY(?: BLOCK)?-----")
_BODY = re.compile(r"[A-Za-z0-9+/=]{16,}")
_WORDS = ("password", "token", "secret", "key", "value", "runbook", "vault", "environment", "variable", "default", "expired", "invalid", "required", "missing", "rotated", "rotation", "generated", "configured", "provided")


def _b64(text: str) -> bytes | None:
    try:
        return base64.urlsafe_b64decode(text + "=" * (-len(text) % 4))
    except (binascii.Error, ValueError):
        return None


def _crc62(text: str) -> str:
    digits, n, out = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz", zlib.crc32(text.encode()), ""
    while n:
        n, r = divmod(n, 62)
        out = digits[r] + out
    return out.rjust(6, "0")


def checksum_ok(token: str) -> bool:
    """Whether the last six characters of a token with a prefix are the base-62 CRC-32 of those before them."""
    body = token.partition("_")[2]
    return len(body) > 6 and _crc62(body[:-6]) == body[-6:]


def verified(kind: str, token: str) -> bool | None:
    """Whether the checksum or structure of a token of an issuer's format holds; None if its kind has neither.

    Old and invented tokens have no checksum, so a failed one doesn't reject a token; a JWT whose head isn't JSON is none.
    """
    if kind == "jwt":
        try:
            return isinstance(json.loads(_b64(token.split(".")[0]) or b""), dict)
        except ValueError:
            return False
    return checksum_ok(token) if kind in ("github-token", "npm-token") else None


def _structured(kind: str, token: str) -> bool:
    """Whether a token of an issuer's format can be real: JWT parts decode, and the random part isn't a filler."""
    if (holds := verified(kind, token)) or kind == "jwt":
        return bool(holds)
    body = re.sub(r"^(?:github_pat_|gh[pousr]_|gl\w+-|xox\w-|npm_|[sr]k_(?:live|test)_|sk-|AKIA|ASIA|AIza|SG\.)", "", token)
    return len(set(body)) >= 6 and not re.search(r"(?i)example|xxxx|0{8}|1234567890abcdef|your|redacted|placeholder|sample", body)


def _scattered(v: str) -> bool:
    """Whether lower and upper case alternate as in random text, not as in words."""
    return len(re.findall(r"[a-z](?=[A-Z])|[A-Z]{2}(?=[a-z])", v)) >= 3


def _usable(value: str | None, named: bool = True) -> bool:
    """Whether a value can be a secret: no placeholder, reference, digest, id, number, prose or path."""
    if value is None:
        return False
    v = value.strip()
    if len(v) < (6 if named else 8) or _PLACEHOLDER.match(v) or _REFERENCE.match(v) or _UUID.match(v) or _DIGEST.match(v):
        return False
    if _TEXTUAL.match(v) or " " in v and not re.search(r"\d", v) or v.count(" ") > 4:
        return False
    if v.isdigit() and len(v) < 9 or len(set(v)) < 4:
        return False
    if "://" in v or re.fullmatch(r"(?:\.{0,2}/)?[\w\-]+(?:/[\w.\-]+)*/[\w.\-]+", v) and not re.search(r"[0-9]", v) and not _scattered(v):
        return False
    if v.startswith(("-----BEGIN", "ssh-rsa", "ssh-ed25519", "AAAAB3")):
        return False
    if "${" in v or "{{" in v or "#{" in v:
        return False
    return True


def _secret_name(name: str) -> bool:
    return bool(_SECRET_NAME.search(name)) and not _PUBLIC_NAME.search(name)


def _expression(v: str) -> bool:
    """Whether an unquoted value is code (a call, a member, a bare identifier) rather than a literal."""
    if re.search(r"[()\[\]{}]|::|->", v) or re.fullmatch(r"[A-Za-z_$][\w$]*(?:\.[A-Za-z_$][\w$]*)+", v):
        return True
    return bool(re.fullmatch(r"[A-Za-z_][A-Za-z_]*", v))


def line_hits(line: str, before: str, language: str | None = None) -> list[tuple[int, int, str]]:
    """Spans [start, end) of secrets that begin on ``line``, with kinds; ``before`` is the line before it."""
    hits: list[tuple[int, int, str]] = []

    def add(m: re.Match, group: int, kind: str, named: bool = True) -> None:
        if m.group(group) is not None and _usable(m.group(group), named):
            hits.append((m.start(group), m.end(group), kind))

    for m in _PRIVATE.finditer(line):
        rest = line[m.end() :]
        inline = _PEM_END.search(rest)
        if inline is None or _BODY.search(rest[: inline.start()]):
            hits.append((m.start(), m.end() + (inline.end() if inline else 0), "private-key"))
    for m in _ISSUER.finditer(line):
        kind = m.lastgroup.replace("_", "-")
        if _structured(kind, m.group()):
            hits.append((m.start(), m.end(), kind))
    for m in _URL.finditer(line):
        add(m, 2, "address", named=False) if len(m.group(2)) < 6 else add(m, 2, "address")
    for m in _PAIRS.finditer(line):
        add(m, 1, "connection-string")
    for m in _HEADER.finditer(line):
        g = next((g for g in (2, 4, 5) if m.group(g)), None)
        scheme = (m.group(1) or m.group(3) or "").lower()
        if g and (scheme != "basic" or b":" in (_b64(m.group(g)) or b"")) and (g != 4 or re.search(r"\d", m.group(4))):
            add(m, g, "header")
    for m in _OPTION.finditer(line):
        add(m, 1 if m.group(1) else 2, "option")
    for m in _CALL.finditer(line):
        g = next((g for g in (4, 5, 6) if m.group(g)), None)
        user = next((m.group(g) for g in (1, 2, 3) if m.group(g)), "")
        if g and re.fullmatch(r"[\w.@\-\\]{1,64}", user):
            add(m, g, "call")
    for pattern in _NAMED:
        for m in pattern.finditer(line):
            if _secret_name(m.group(1)):
                g = next((g for g in (2, 3, 4) if m.group(g)), None)
                if g:
                    add(m, g, "assignment")
    if (m := _BARE.match(line)) and _secret_name(m.group(1)) and not (language in _CODE and _expression(m.group(2))) and not re.fullmatch(r"[A-Za-z_]\w*\(.*", m.group(2)):
        if language in _CODE or re.search(r"\d|[^\w.]", m.group(2)) or len(m.group(2)) > 11 and not _expression(m.group(2)):
            if not (language in _CODE and re.fullmatch(r"[A-Za-z_]\w*", m.group(2)) and len(m.group(2)) < 20):
                add(m, 2, "assignment")
    if (m := _OPEN.search(before) or _OPEN_CALL.search(before)) and _secret_name(m.group(1)):
        if v := _FIRST_STRING.match(line):
            g = next((g for g in (1, 2, 3) if v.group(g)), None)
            if g:
                add(v, g, "assignment")
        elif re.search(r"(?:[|>][-+]?|\"\"\"|'''|`|\\)\s*$", before) and (v := _FIRST_BARE.match(line)):
            add(v, 1, "assignment")
    if c := _COMMENT.search(line):
        for m in _SPOKEN.finditer(line, c.start(c.lastindex)):
            v = m.group(1).rstrip(".:!?")
            if (re.search(r"\d", v) or _scattered(v)) and re.search(r"[A-Za-z]", v) and not re.search(r"(?i)^(?:%s)\b" % "|".join(_WORDS), v) and not re.fullmatch(r"[a-z\-]+(?:/[a-z\-]+)+|[\w.]+\([^)]*\)?|#?\d+\w?|\d{4}-\d\d-\d\d|v?\d+(?:\.\d+)+", v) and _usable(v, named=False):
                hits.append((m.start(1), m.start(1) + len(v), "comment"))
    return hits


# Languages in which an unquoted right-hand side is an expression.
_CODE = {"python", "typescript", "javascript", "java", "go", "rust", "csharp", "tsx", "jsx", "vue", "kotlin", "c", "cpp"}


_HEX, _BASE32 = re.compile(r"[0-9a-fA-F]+"), re.compile(r"[A-Z2-7]+")


def placeholder(value: str) -> str:
    """A string of the same length and alphabet, so that what decodes the value still decodes it.

    Letters become x or X and digits 0; in hexadecimal text letters become a or A, in base 32 all become A or 2. Signs
    stay. What is hexadecimal or base 32 is told from the letters and digits alone.
    """
    bare = "".join(c for c in value if c.isalnum())
    low, up, digit = ("a", "A", "0") if _HEX.fullmatch(bare) else ("x", "A", "2") if _BASE32.fullmatch(bare) else ("x", "X", "0")
    return "".join(digit if c.isdigit() else up if c.isupper() else low if c.isalpha() else c for c in value)


def _automaton() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for k in KEYWORDS:
        a.add_word(k, len(k))
    a.make_automaton()
    return a


#: A line of a private key: base 64, quoted or as a comment, or a header; a short one is the last.
_KEY_LINE = re.compile(r"[\s\"'`+#*/;,.()\\-]*(?:([A-Za-z0-9+/]{16,}={0,2})|([A-Za-z0-9+/]{1,15}={0,2})|(?:Proc-Type|DEK-Info|Version|Comment): ?.*)?(?:\\[nr])*[\s\"'`+;,.()\\-]*")


def scan(lines: list[str], language: str | None, automaton: ahocorasick.Automaton) -> dict[int, tuple[str, list[str], list[str]]]:
    """Place of a line -> (redacted line, kinds, verified kinds), for lines on which a secret begins or goes on.

    A private key goes on to its END line, or to the first line that can't be part of a key.
    """
    text = "\n".join(lines)
    low = text.lower()
    if len(low) != len(text):  # a letter that grows in lower case
        low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
    starts, at = [], 0
    for x in lines:
        starts.append(at)
        at += len(x) + 1
    look, i = set(), 0
    for end, _ in automaton.iter(low):
        while i + 1 < len(starts) and starts[i + 1] <= end:
            i += 1
        look.add(i)
    found: dict[int, tuple[str, list[str], list[str]]] = {}
    for i in sorted(look | {i + 1 for i in look if i + 1 < len(lines)}):
        if i in found and not found[i][1]:
            continue  # inside a private key that began above
        hits = line_hits(lines[i], lines[i - 1] if i else "", language)
        if not hits:
            continue
        out = lines[i]
        for a, b, _ in hits:
            if (m := _PRIVATE.match(out[a:b])) is None:
                out = out[:a] + placeholder(out[a:b]) + out[b:]
            else:
                out = out[: a + m.end()] + _BODY.sub(lambda x: placeholder(x.group()), out[a + m.end() : b]) + out[b:]
        found[i] = (out, sorted({k for _, _, k in hits}), sorted({k for a, b, k in hits if verified(k, lines[i][a:b])}))
        if any(k == "private-key" for _, _, k in hits) and not _PEM_END.search(lines[i]):
            for j in range(i + 1, len(lines)):
                m = _KEY_LINE.fullmatch(lines[j])
                if _PEM_END.search(lines[j]) or not m:
                    break
                at, last = m.span(1) if m[1] else m.span(2), bool(m[2])
                if at[0] >= 0:
                    found[j] = (lines[j][: at[0]] + placeholder(lines[j][at[0] : at[1]]) + lines[j][at[1] :], [], [])
                if last:
                    break
    return found


_SEPARATOR = "\u001e"


def find_secrets(units: DataFrame, with_text: bool = True) -> DataFrame:
    """(unit_id, line_no, kinds, verified, text): lines with secrets, with the secret replaced; once per line.

    A missing language is taken from the path, if there is one. ``kinds`` is empty for the later lines of a private
    key; ``verified`` are those whose checksum or structure holds. Null lines are empty; null or empty line lists give nothing; units sent again and repeated rows count once.
    Only lines with a secret leave the Python workers.
    """

    def run(batches):
        automaton = _automaton()
        for b in batches:
            out = {"unit_id": [], "line_no": [], "kinds": [], "verified": [], "text": []}
            for uid, start, language, joined in zip(*(c.to_pylist() for c in b.columns)):
                for i, (t, kinds, sure) in scan(joined.split(_SEPARATOR), language, automaton).items():
                    for name, x in zip(out, (uid, start + i, kinds, sure, t if with_text else None)):
                        out[name].append(x)
            yield pa.RecordBatch.from_pydict(out, schema=schema)

    schema = pa.schema([("unit_id", pa.int64()), ("line_no", pa.int32()), ("kinds", pa.list_(pa.string())), ("verified", pa.list_(pa.string())), ("text", pa.string())])
    lines = F.array_join(F.transform("source_lines", lambda x: F.translate(F.coalesce(x, F.lit("")), _SEPARATOR, " ")), _SEPARATOR)
    language = F.lower("language_id")
    if "path" in units.columns:
        language = F.coalesce(language, detected_language(F.col("path"), F.lit(None).cast("string")))
    given = units.where(F.col("start_line").isNotNull() & (F.size("source_lines") > 0))
    given = given.select(F.col("unit_id").cast("long"), F.col("start_line").cast("int"), language.alias("language_id"), lines.alias("lines"))
    hits = given.mapInArrow(run, "unit_id bigint, line_no int, kinds array<string>, verified array<string>, text string")
    return hits.dropDuplicates(["unit_id", "line_no"])


def redacted_units(units: DataFrame) -> DataFrame:
    """(unit_id, source_lines): each unit once, with its secrets replaced and everything else as it was."""
    hits = staged(find_secrets(units), "secrets")
    changed = hits.groupBy("unit_id").agg(F.map_from_entries(F.collect_list(F.struct("line_no", "text"))).alias("_new"))
    base = units.select("unit_id", "start_line", "source_lines").dropDuplicates(["unit_id"]).join(changed, "unit_id", "left")
    new = F.transform("source_lines", lambda x, i: F.coalesce(F.try_element_at("_new", F.col("start_line") + i), x))
    return base.select("unit_id", F.when(F.col("_new").isNull(), F.col("source_lines")).otherwise(new).alias("source_lines"))
