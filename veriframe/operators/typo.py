"""Spelling and grammar checks of page-marked text against a dictionary.

Order inside a text matters: a doubled word and a separated prefix consume their second token. Tokens see their
neighbours inside their row, before they are exploded; only the few tokens that may open a pair are windowed.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import strip

WORD = "[A-Za-z]+(?:-[A-Za-z]+)*"
RADIUS = 60
#: Words of a dictionary that is sent to all executors; a larger one is joined by shuffles.
BROADCAST_WORDS = 1_000_000
#: Tokens from which on a batch is handed on.
BATCH_TOKENS = 1 << 16
# Non-standard words and their standard forms; month names that are no fragments.
STANDARD = {
    "resiko": "risiko", "aktifitas": "aktivitas", "aktifitasnya": "aktivitasnya", "jaman": "zaman", "ijin": "izin",
    "kwalitas": "kualitas", "kwantitas": "kuantitas", "analisa": "analisis", "sistim": "sistem", "konsekwensi": "konsekuensi",
    "frekwensi": "frekuensi", "aktip": "aktif", "negatip": "negatif", "positip": "positif", "efektip": "efektif",
    "subyek": "subjek", "obyek": "objek", "komplit": "komplet", "nasehat": "nasihat", "hakekat": "hakikat",
    "praktek": "praktik", "karir": "karier", "standarisasi": "standardisasi", "sekedar": "sekadar", "terlanjur": "telanjur",
    "nafas": "napas", "trampil": "terampil", "jadual": "jadwal", "hirarki": "hierarki", "menejemen": "manajemen",
}
MONTHS = (
    "januari", "februari", "maret", "april", "mei", "juni", "juli", "agustus", "september", "oktober", "november", "desember",
    "jan", "feb", "mar", "apr", "jun", "jul", "agu", "ags", "agt", "sep", "okt", "nov", "des",
)


#: Neighbours of a token: words, and the gaps behind words, by their places from it.
AROUND = {"w-2": -2, "w-1": -1, "w1": 1, "w2": 2, "g-2": -2, "g-1": -1, "g1": 1}


def _shifted(values: list, by: int) -> list:
    """values[i + by] at every place i, None beyond the ends."""
    n = len(values)
    return values[by:] + [None] * min(by, n) if by > 0 else [None] * min(-by, n) + values[: max(n + by, 0)]


def _tokens(around: Sequence[str], fields: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pattern = re.compile(WORD)
        for batch in batches:
            of, columns = [], [[] for _ in fields]
            for row, text in enumerate(batch.column(1)):
                found = list(pattern.finditer(text.as_py() or ""))
                if not found:
                    continue
                words, starts, ends = [m[0] for m in found], [m.start() for m in found], [m.end() for m in found]
                whole = found[0].string
                gaps = [whole[e:s] for e, s in zip(ends, [*starts[1:], len(whole)])]
                values = [range(len(words)), words, starts, ends, gaps, *(_shifted(words if n[0] == "w" else gaps, AROUND[n]) for n in around)]
                of += [row] * len(words)
                for column, more in zip(columns, values):
                    column += more
                if len(of) >= BATCH_TOKENS:
                    yield _batch(batch, of, columns, fields)
                    of, columns = [], [[] for _ in fields]
            if of:
                yield _batch(batch, of, columns, fields)

    return run


def _batch(batch: pa.RecordBatch, of: list[int], columns: list[list], fields: list[str]) -> pa.RecordBatch:
    kinds = [pa.int32() if f in ("pos", "start", "end") else pa.string() for f in fields]
    return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(of, pa.int64())), *map(pa.array, columns, kinds)], [batch.schema.names[0], *fields])


def tokenise(docs: DataFrame, key: str = "doc_id", text: str = "text", around: Sequence[str] = ()) -> DataFrame:
    """(key, pos, word, start, end, gap): tokens with half-open offsets and the marks up to the next token.

    Offsets count characters. around: neighbours (of AROUND) that are wanted as columns. Null texts and texts without words have
    none. One pass over the text in Arrow batches: offsets folded by higher-order functions, which are
    interpreted, cost many times as much.
    """
    fields = ["pos", "word", "start", "end", "gap", *around]
    kinds = {"pos": "int", "start": "int", "end": "int"}
    schema = ", ".join([f"`{key}` {docs.schema[key].dataType.simpleString()}", *(f"`{f}` {kinds.get(f, 'string')}" for f in fields)])
    return docs.select(key, text).mapInArrow(_tokens(around, fields), schema)


def strip_markers(docs: DataFrame, key: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """((key, text) without page markers, (key, start, end, page_no) spans of the clean text)."""
    parts = docs.select(key, F.posexplode(F.split(text, r"(?=\[== Halaman \d+ ==\])")).alias("n", "block"))
    page = F.nullif(F.regexp_extract("block", r"^\[== Halaman (\d+) ==\]", 1), F.lit("")).cast("int")
    clean = parts.select(key, "n", page.alias("page_no"), F.regexp_replace("block", r"^\[== Halaman \d+ ==\]", "").alias("t"))
    run = Window.partitionBy(key).orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    spans = clean.withColumn("end", F.sum(F.length("t")).over(run).cast("int")).select(key, (F.col("end") - F.length("t")).alias("start"), "end", "page_no")
    whole = clean.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "t"))), lambda x: x["t"]), "").alias("text"))
    return whole, spans


def _known(dictionary: DataFrame) -> DataFrame:
    """(known): distinct lower-case words and months, to be sent to all executors if they are few enough."""
    words = dictionary.select(F.lower("word").alias("known")).where("known IS NOT NULL")
    known = words.unionByName(dictionary.sparkSession.createDataFrame([(m,) for m in MONTHS], "known string")).distinct()
    return F.broadcast(known) if words.limit(BROADCAST_WORDS + 1).count() <= BROADCAST_WORDS else known


def scan(docs: DataFrame, dictionary: DataFrame) -> DataFrame:
    """One row per finding: doc_id, pos, start, end, kind, category, text, suggestion, key.

    docs (doc_id, text) without page markers; dictionary (word). kind is reduplication, nonstandard (both
    certain), di_ke_prefix or unknown_word (both to be judged). Findings come by token order and a
    consumed token takes part in nothing else. Null and empty texts have none.

    Tokens are not shuffled while the dictionary fits BROADCAST_WORDS: words it holds are dropped by an anti join, joined
    neighbours are looked up for the rest only. What is shuffled by document are findings.
    """
    known = _known(dictionary)
    low = F.lower("word")
    adjacent = F.col("w1").isNotNull() & (strip(F.col("gap")) == "")
    doubles = adjacent & (F.col("w1") == F.lower("w1")) & (F.col("w1") == low) & ~F.contains("word", F.lit("-")) & (F.length("word") >= 3)
    standard = F.try_element_at(F.create_map(*[F.lit(x) for kv in STANDARD.items() for x in kv]), low)
    separate = adjacent & low.isin("di", "ke") & ~doubles
    pairs = tokenise(docs, around=["w1"]).where(doubles | separate).withColumns({"doubled": doubles, "joined": F.when(separate, F.lower(F.concat("word", "w1")))})
    pairs = pairs.join(known, pairs["joined"] == known["known"], "left").where("doubled OR known IS NOT NULL")
    # A pair takes two tokens. In a run of tokens that each could open a pair with the next, every other does.
    order = Window.partitionBy("doc_id").orderBy("pos")
    pairs = pairs.withColumn("run", F.col("pos") - F.row_number().over(order))
    pairs = pairs.withColumn("nth", F.row_number().over(Window.partitionBy("doc_id", "run").orderBy("pos"))).where("nth % 2 = 1")
    two = ["doc_id", "pos", "start", (F.col("end") + F.length("gap") + F.length("w1")).alias("end")]
    both = F.concat_ws(" ", "word", "w1").alias("text")
    none = F.lit(None).cast("string")

    def finding(kind: str, category: str | None, text: Column, suggestion: Column, key: Column, span: list) -> list:
        return [*span, F.lit(kind).alias("kind"), F.lit(category).cast("string").alias("category"), text, suggestion.alias("suggestion"), key.alias("key")]

    redoubled = pairs.where("doubled").select(*finding("reduplication", "grammar", both, F.concat_ws("-", "word", "w1"), none, two))
    prefixed = pairs.where("NOT doubled").select(*finding("di_ke_prefix", None, both, F.col("joined"), F.concat(F.lit("di_ke:"), F.lower("w1")), two))

    one, word = ["doc_id", "pos", "start", "end"], F.col("word").alias("text")
    wrong = tokenise(docs).where(standard.isNotNull()).select(*finding("nonstandard", "tidak_baku", word, standard, none, one))
    left, right = F.col("g-1") == " ", (F.col("gap") == " ") & F.col("w1").isNotNull()
    joins = (
        F.when(left, F.lower(F.concat("w-1", "word"))), F.when(left & (F.col("g-2") == " "), F.lower(F.concat("w-2", "w-1", "word"))),
        F.when(right, F.lower(F.concat("word", "w1"))), F.when(right & (F.col("g1") == " "), F.lower(F.concat("word", "w1", "w2"))),
        F.when(left & right, F.lower(F.concat("w-1", "word", "w1"))),
    )
    fragment = (F.col("word") == low) & (F.length("word") >= 2) & ~((F.length("word") == 2) & ~F.col("word").rlike("[aiueo]")) & standard.isNull()
    lost = tokenise(docs, around=list(AROUND)).where(fragment)
    for e in (F.col("word"), *joins):
        lost = lost.withColumn("__e", e)
        lost = lost.join(known, lost["__e"] == known["known"], "left_anti").drop("__e")
    lost = lost.select(*finding("unknown_word", None, word, none, F.concat(F.lit("word:"), low), one))

    taken = pairs.select("doc_id", F.explode(F.array(F.col("pos"), F.col("pos") + 1)).alias("pos"))
    rest = wrong.unionByName(lost).join(taken, ["doc_id", "pos"], "left_anti").select(redoubled.columns)
    return redoubled.unionByName(prefixed).unionByName(rest)


def candidates(findings: DataFrame, docs: DataFrame) -> DataFrame:
    """(doc_id, key, kind, text, hint, context, occurrences): findings to be judged, one row a word, the first one's context."""
    open_ = findings.where("key IS NOT NULL")
    first = F.min_by(F.struct("text", "start", "end", "kind", "suggestion"), "pos")
    grouped = open_.groupBy("doc_id", "key").agg(first.alias("f"), F.array_sort(F.collect_list(F.struct("start", "end", "text"))).alias("occurrences"))
    lo = F.greatest(F.col("f.start") - RADIUS, F.lit(0))
    return grouped.join(docs.select("doc_id", F.col("text").alias("__t")), "doc_id").select(
        "doc_id", "key", "f.kind", "f.text", F.col("f.suggestion").alias("hint"), F.substring(F.col("__t"), lo + 1, F.col("f.end") + RADIUS - lo).alias("context"), "occurrences"
    )


def issues(findings: DataFrame, judged: DataFrame, verdicts: DataFrame, spans: DataFrame) -> DataFrame:
    """All issues by start: certain findings, and every occurrence of candidates with a positive verdict.

    judged: candidates(); verdicts (doc_id, key, is_issue, category, suggestion); spans from strip_markers().
    """
    sure = findings.where("key IS NULL").select("doc_id", "text", "start", "end", "category", "suggestion")
    yes = judged.join(verdicts.where("is_issue").select("doc_id", "key", "category", "suggestion"), ["doc_id", "key"])
    told = yes.select("doc_id", "category", "suggestion", F.explode("occurrences").alias("o")).select("doc_id", "o.text", "o.start", "o.end", "category", "suggestion")
    every = sure.unionByName(told)
    page = every.join(spans.withColumnsRenamed({"start": "s", "end": "e"}), "doc_id", "left").where("s IS NULL OR (start >= s AND start < e)")
    return page.drop("s", "e").orderBy("doc_id", "start")


def issue_counts(found: DataFrame) -> DataFrame:
    return found.groupBy("doc_id").agg(*[F.count_if(F.col("category") == c).alias(c) for c in ("ejaan", "tidak_baku", "grammar")], F.count("*").alias("total"))
