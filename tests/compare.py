"""Order-insensitive comparison of a Spark result with a DuckDB result."""

import math


def norm(v):
    if v is None:
        return "~"
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v + 0.0:.9g}"
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, (list, tuple)):
        return str([norm(x) for x in v])
    return str(v)


def rows(frame):
    frame = frame[sorted(frame.columns)]
    frame = frame.astype(object).where(frame.notna(), None)
    return sorted("\x01".join(norm(v) for v in r) for r in frame.itertuples(index=False, name=None))
