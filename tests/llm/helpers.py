"""Small inputs and plain restatements of the operators' rules."""

import re
import zlib
from collections import defaultdict

TEXT = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, rows):
    """(id, text[, lang[, source]]) rows as a documents table."""
    full = [(r[0], r[1], r[2] if len(r) > 2 else "en", r[3] if len(r) > 3 else "s", len(r[1] or "")) for r in rows]
    return spark.createDataFrame(full, TEXT)


def crc(i):
    return zlib.crc32(str(i).encode())


def lower_ascii(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def spaced(t):
    return re.findall(r"[^\x20\x09-\x0D]+", lower_ascii(t))


def alnum(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower_ascii(t))


def union_find(nodes, pairs):
    """node -> smallest node of its component."""
    up = {n: n for n in nodes}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


def grouped(pairs):
    out = defaultdict(set)
    for k, v in pairs:
        out[k].add(v)
    return out
