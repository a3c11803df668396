import random

import pytest

LONG = " ".join(f"kata{i % 977}x{i % 31}" for i in range(60_000))
DOC = "doc_id long, text string, lang string, source string, n_chars long, score string, rank string, shard int, rep string, `group` string, words string"


def prose(seed: int, n: int = 120) -> str:
    r = random.Random(seed)
    return " ".join("".join(r.choice(("ba", "ri", "to", "ne", "lu", "sé")) for _ in range(r.randint(1, 4))) for _ in range(n)) + "."


@pytest.fixture(scope="session")
def rows():
    """(doc_id, text): null ids and texts, empty and blank ones, repeated rows, copies, near copies, one very long text."""
    out = [(i, prose(i)) for i in range(1, 41)]
    out += [(50, None), (51, ""), (52, " \n\t "), (None, "tanpa id sama sekali"), (None, None), (53, LONG), (54, "satu"), (55, "satu dua"), (56, "satu dua")]
    out += [(7, prose(7)), (7, prose(7))]  # repeated rows
    out += [(60 + i, prose(99)) for i in range(12)]  # copies
    base = prose(123, 200).split()
    for i in range(8):  # near copies
        w = list(base)
        w[10 + 17 * i] = f"beda{i}"
        out.append((80 + i, " ".join(w)))
    out += [(100, "Ünïcödé — “teks” 日本語 ́ 😀 <|endoftext|> \x1c ½ don't\r\n  spasi　lebar "), (101, "x" * 3000)]
    return out


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame([(i, t, "id", "s", len(t or ""), "s", "r", 1, "p", "g", "w") for i, t in rows], DOC).repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOC)
