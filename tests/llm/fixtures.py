"""Small tables with every awkward case: nulls in any column, empty and long texts, ties, repeated rows, clashing column names."""

from __future__ import annotations

import random

from pyspark.sql import DataFrame, SparkSession

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Columns that bear the names of results and helpers; operators must replace or pass by them.
CLASHES = {"score": "'s'", "shard": "'x'", "size": "'y'", "simhash": "'z'", "toxic": "'t'", "toxicity": "'t'", "n_hit": "'h'", "n_words": "'w'", "component_id": "'c'", "key": "'k'", "tag": "'g'", "fp": "'f'", "digest": "'d'", "batch": "'b'", "bucket": "'u'"}
WORDS = "alder birch cedar dogwood elm fir ginkgo hazel ironwood juniper kapok larch maple nutmeg oak pine quince rowan spruce teak".split()


def prose(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(WORDS) + str(rng.randrange(40)) for _ in range(n))


def documents(seed: int = 1, n: int = 60) -> list[tuple]:
    """Rows (doc_id, text, lang, source, n_chars) with copies, near copies, shared passages and awkward rows."""
    rng = random.Random(seed)
    passage = prose(rng, 70)
    rows = []
    for k in range(n):
        text = prose(rng, rng.randrange(1, 120))
        if k % 6 == 1:
            text = text + "\n" + passage
        if k % 6 == 2 and rows:
            text = rows[rng.randrange(len(rows))][1] or ""
        if k % 6 == 3 and rows and rows[-2][1]:
            text = rows[-2][1] + " extra"
        if k % 11 == 5:
            text = text.upper() + " ÄÖÜ ß \x00\x0b日本語　の"
        rows.append((k, text, rng.choice(["en", "de", None]), f"src{rng.randrange(3)}", len(text)))
    long = prose(rng, 9000)
    rows += [
        (n, None, None, None, None), (n + 1, "", "en", "src0", 0), (n + 2, "   \n\t ", "de", "src1", 6), (n + 3, "one", "en", "src1", 3), (n + 4, "two words", None, None, None),
        (n + 5, long, "en", "src0", len(long)), (n + 6, long, "en", "src2", len(long)), (n + 7, "tie tie tie tie", "en", "src2", 15), (n + 7, "tie tie tie tie", "en", "src2", 15), (None, "no id here", "en", "src0", 10), (None, None, None, None, None),
    ]
    return rows


def frame(spark: SparkSession, rows: list[tuple], clash: bool = True) -> DataFrame:
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    return df.selectExpr("*", *(f"{v} as {k}" for k, v in CLASHES.items())) if clash else df


def smallest_reachable(n: int, links: list[tuple[int, int]]) -> list[int]:
    """Component (least index) of each of n nodes."""
    root = list(range(n))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(x) for x in range(n)]
