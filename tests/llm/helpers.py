"""Brute-force counterparts of the operators, over small tables with awkward rows."""

import hashlib
import random
from collections import Counter

BIG = 2**63 - 1
TEXT_SCHEMA = "doc_id long, text string, size int, a long, run long"


def awkward_texts() -> list[tuple]:
    """Copies, shifted copies, nulls, empty texts, repeated rows, repetitive texts and one id for two texts."""
    r = random.Random(5)
    words = ["ab", "the", "of", "x", "é", "Zebra", "long" + "y" * 30]
    base = [" ".join(r.choice(words) for _ in range(r.randint(0, 300))) for _ in range(15)]
    docs = list(enumerate(base))
    for i in range(15, 40):
        t = base[i % 15]
        p = r.randint(0, len(t))
        docs.append((i, r.choice(["q ", "\n\n", ""]) + t[p : r.randint(p, len(t))] + r.choice([" tail", "\t", t[:200]])))
    docs += [(None, base[3]), (None, None), (None, None), (7, base[3]), (9, base[9]), (9, base[9]), (100, "a" * 1500)]
    docs += [(101, "b" * 700), (102, None), (103, ""), (104, "w " * 400), (105, " \n\t "), (106, "日本 <|endoftext|>\x85 x" * 30)]
    return docs


def text_frame(spark, docs):
    """With extra columns whose names the operators use inside."""
    return spark.createDataFrame([(d, t, 1, 2, 3) for d, t in docs], TEXT_SCHEMA).repartition(3)


def ordered(rows) -> list[tuple]:
    return sorted((tuple(r) for r in rows), key=lambda r: [(v is None, str(v)) for v in r])


def sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def brute_bytes(docs, window=200):
    met = Counter()
    for _, t in docs:
        b = (t or "").encode()
        met.update(b[i : i + window] for i in range(len(b) - window + 1))
    out = []
    for d, t in docs:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - window + 1):
            if met[b[i : i + window]] > 1:
                gone[i : i + window] = b"\1" * window
        spans = sum(1 for i in range(len(gone)) if gone[i] and (i == 0 or not gone[i - 1]))
        out.append((d, len(b), sum(gone), spans, sha(bytes(x for x, g in zip(b, gone, strict=True) if not g))))
    return out


def brute_words(docs, window=13):
    first: dict[bytes, int] = {}
    rows = [(BIG if d is None else d, (t or "").encode().split()) for d, t in docs]
    for d, w in rows:
        for i in range(len(w) - window + 1):
            key = b" ".join(w[i : i + window])
            first[key] = min(first.get(key, BIG), d)
    out = []
    for (doc_id, _), (d, w) in zip(docs, rows, strict=True):
        gone = [0] * len(w)
        for i in range(len(w) - window + 1):
            if first[b" ".join(w[i : i + window])] < d:
                gone[i : i + window] = [1] * window
        out.append((doc_id, len(w), sum(gone), sha(b" ".join(x for x, g in zip(w, gone, strict=True) if not g))))
    return out


def roots(n: int, links) -> list[int]:
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]
