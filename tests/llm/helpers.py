"""Brute-force versions and small frames for the tests."""

import collections
import re
from pathlib import Path

from pyspark.sql import types as T

from dawnchorus.session import shared_dir

SF = "/root/testdata/sf0.001"
DOCS = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])
#: Names that the operators use inside, as extra columns of the input.
CLASHING = ("rid", "row", "body", "words", "kept", "key", "label", "component_id", "n_words", "mix_copy", "u", "toxic", "host")


def docs(spark, rows):
    """rows: (doc_id, text) or (doc_id, text, source)."""
    full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", len(r[1] or "")) for r in rows]
    return spark.createDataFrame(full, DOCS)


def with_clashes(frame):
    from pyspark.sql import functions as F
    for name in CLASHING:
        if name not in frame.columns:
            frame = frame.withColumn(name, F.lit("x"))
    return frame


def scratch(spark):
    """Bytes of each file that lies below the shared folder, by its table's folder and its name."""
    root = Path(shared_dir(spark).removeprefix("file:"), "dawnchorus")
    return {(p.parent.name, p.name): p.stat().st_size for p in root.rglob("*.parquet")}


def shingle_set(text):
    lowered = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    if 0 < len(words) < 5:
        return {tuple(words)}
    return {tuple(words[i:i + 5]) for i in range(len(words) - 4)}


def jaccard_components(rows):
    """{doc_id: (set size, smallest id reachable)} by comparing every pair that shares a shingle."""
    sets = {i: shingle_set(t) for i, t in rows if i is not None}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    met = collections.defaultdict(list)
    for i in sorted(sets):
        common = collections.Counter(j for s in sets[i] for j in met[s])
        for j, n in common.items():
            if 100 * n >= 80 * (len(sets[i]) + len(sets[j]) - n):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
        for s in sets[i]:
            met[s].append(i)
    return {i: (len(sets[i]), find(i)) for i in sets}
