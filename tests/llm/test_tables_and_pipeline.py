import collections
import gzip
import hashlib
import json
import re
import zlib

import numpy as np
from pyarrow import fs

from veriframe.llm import block_topk, one_bit_ann, warc

from .conftest import prose

PAGES = "page_id long, url string, html string, winner string, digest int"


def pages(spark):
    big, small = "<p>" + "x" * 1500 + "é</p>", "<p>kecil</p>"
    rows = [(1, "http://a/\r\nX: y", big), (2, "http://b", small), (3, None, big), (4, "u", None), (5, "u", ""), (6, "u", small), (9, "u", big), (9, "u", big), (None, "u", big), (7, "u", prose(1, 30000)), (8, "u", "y" * 1000), (10, "u", "y" * 999), (11, "u", "y" * 999), (12, "u", "y" * 1000), (13, "u", "a\r\n\r\nWARC/1.1\r\n")]
    return rows, spark.createDataFrame([(*r, "w", 1) for r in rows], PAGES)


def test_warc_round_trip(spark):
    rows, df = pages(spark)
    winner = {}
    for i, _, h in rows:
        if len((h or "").encode()) >= 1000 and i is not None:
            winner[h] = max(winner.get(h, -1), i)
    want = collections.Counter()
    for i, _, h in rows:
        data = (h or "").encode()
        w = winner.get(h) if h in winner and winner[h] != i else None
        want[i, len(data), hashlib.sha1(data).hexdigest(), "revisit" if w is not None else "response", w] += 1
    files = warc.write_archives(df)
    got = collections.Counter(tuple(r) for r in warc.read_archives(files).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect())
    assert got == want
    assert warc.read_archives(warc.write_archives(spark.createDataFrame([], PAGES))).count() == 0
    first = files.first()
    store, _ = fs.FileSystem.from_uri(first["base"])
    with store.open_input_stream(first["archive"], compression=None) as f:
        data = f.read()
    with store.open_input_stream(first["index"], compression=None) as f:
        entries = [json.loads(x) for x in f.read().splitlines()]
    assert len(entries) == first["records"] and sum(e["length"] for e in entries) == len(data)
    assert all(gzip.decompress(data[e["offset"] : e["offset"] + e["length"]]).startswith(b"WARC/1.1") for e in entries)


def test_normaliser_reads_one_or_many_members(tmp_path):
    store = fs.LocalFileSystem()
    raw = [warc.record_bytes(i, "u", prose(i, 400).encode(), "d", None, False) for i in range(50)]
    for name, data in (("one", gzip.compress(b"".join(raw))), ("many", b"".join(map(gzip.compress, raw)))):
        (tmp_path / name).write_bytes(data)
        _, _, n = warc.normalise(store, str(tmp_path / name), str(tmp_path / f"{name}.out"))
        assert n == 50 and gzip.decompress((tmp_path / f"{name}.out").read_bytes()) == b"".join(raw)


def vectors(spark, n=700, dim=24):
    rng = np.random.default_rng(1)
    x = rng.standard_normal((n, dim)).astype(np.float32)
    x[40:60] = x[40]  # ties
    rows = [(i, v.tolist(), 0, "s", "r") for i, v in enumerate(x)]
    odd = [(1000, None), (1020, []), (1040, [0.0] * dim), (1060, [float("nan")] * dim), (1080, [float("inf")] + [0.0] * (dim - 1)), (1100, [None] * dim), (None, [1.0] * dim), (1120, [1.0, 2.0])]
    rows += [(i, v, 0, "s", "r") for i, v in odd] + rows[20:23]
    return x, spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, score string, rank string")


def test_one_bit_ann(spark):
    x, df = vectors(spark)
    out = collections.defaultdict(list)
    for r in one_bit_ann.nearest(df).orderBy("query_id", "rank").collect():
        out[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    assert set(out) == set(range(0, 700, 20))
    hits = 0
    for q, got in out.items():
        s = (x.astype(float) * x[q].astype(float)).sum(1)
        order = [i for i in np.lexsort((np.arange(700), -s)) if i != q][:20]
        assert [g[0] for g in got] == list(range(1, 21))
        assert all(abs(s[v] - score) < 1e-12 for _, v, score in got)
        hits += len({v for _, v, _ in got} & set(order))
    assert hits / (20 * len(out)) >= 0.97
    assert one_bit_ann.nearest(df.limit(0)).count() == 0
    assert one_bit_ann.nearest(df.where("vec_id IN (0, 1, 2)")).count() == 2


def blocks_of(monkeypatch, module, queries: int, candidates: int):
    from veriframe.llm import vectors as grid

    def small(*args, **more):
        return grid.grid_topk(*args, query_block=queries, candidate_block=candidates, **more)

    monkeypatch.setattr(module, "grid_topk", small)


def test_searches_over_a_grid_of_blocks(spark, monkeypatch):
    """Many query and candidate blocks: the same rows as from one cell, equal to brute force."""
    x, df = vectors(spark)
    blocks_of(monkeypatch, one_bit_ann, 10, 50)
    got = collections.defaultdict(list)
    for r in one_bit_ann.nearest(df).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append(r["vec_id"])
    hits = 0
    for q in range(0, 700, 20):
        s = (x.astype(float) * x[q].astype(float)).sum(1)
        hits += len(set(got[q]) & {i for i in np.lexsort((np.arange(700), -s))[:21] if i != q})
    assert set(got) == set(range(0, 700, 20)) and hits / (20 * 35) >= 0.99
    blocks_of(monkeypatch, block_topk, 2, 50)
    ints = np.vstack([np.floor(1024 * x.astype(np.float64)).astype(np.int64), np.zeros((1, 24), np.int64)])
    ids, out = np.append(np.arange(700), 1040), collections.defaultdict(list)
    for r in block_topk.exact_topk(df).orderBy("query_id", "rank").collect():
        out[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    for q in range(0, 700, 100):
        s = ints @ ints[q]
        order = [k for k in np.lexsort((ids, -s)) if ids[k] != q][:10]
        assert out[q] == [(n, ids[k], s[k]) for n, k in enumerate(order, 1)]


def test_huge_components_hurt_only_their_rows():
    rng = np.random.default_rng(3)
    x = rng.standard_normal((400, 16))
    x[7, 3], x[8, 3] = 1e200, -1e308
    ids = np.arange(400)
    q, _, v, s = one_bit_ann.make_search(5, 3.0)(ids[:40], x[:40], ids, x)
    for own in range(40):
        with np.errstate(over="ignore", invalid="ignore"):
            exact = np.nan_to_num((x * x[own]).sum(1), nan=-np.inf, posinf=np.inf, neginf=-np.inf)
        order = [i for i in np.lexsort((ids, -exact)) if i != own][:5]
        assert v[q == own].tolist() == order and (s[q == own] == exact[order]).all()


def test_codes_are_unbiased():
    rng = np.random.default_rng(2)
    x, q = rng.standard_normal((4000, 32)), rng.standard_normal(32)
    turn = one_bit_ann.rotation(32)
    assert np.allclose(turn @ turn.T, np.eye(32))
    centre, codes, norm, align = one_bit_ann.encode(x, turn)
    signs = np.unpackbits(codes, axis=1, count=32).astype(float) * 2 - 1
    guess = (signs / np.sqrt(32)) @ (q @ turn) * norm / align + q @ centre
    error = guess - x @ q
    bound = norm * np.sqrt(1 - align**2) / align * 3 / np.sqrt(31) * np.sqrt(q @ q)
    assert abs(error.mean()) < 0.1 and (np.abs(error) <= bound).mean() > 0.99


def test_block_topk(spark):
    x, df = vectors(spark)
    ints = np.floor(1024 * x.astype(np.float64)).astype(np.int64)
    ids = np.append(np.arange(700), 1040)
    ints = np.vstack([ints, np.zeros((1, 24), np.int64)])
    out = collections.defaultdict(list)
    for r in block_topk.exact_topk(df).orderBy("query_id", "rank").collect():
        out[r["query_id"]].append((r["vec_id"], r["score"]))
    assert set(out) == set(range(0, 700, 100))
    for q, got in out.items():
        s = ints @ ints[q]
        order = [k for k in np.lexsort((ids, -s)) if ids[k] != q][:10]
        assert got == [(ids[k], s[k]) for k in order]
    assert block_topk.exact_topk(df.limit(0)).count() == 0


def test_block_topk_beyond_double():
    big = np.array([[2.0**40, 1.0], [2.0**40, 2.0], [2.0**40, 3.0]])
    q, _, v, s = block_topk.make_search(2)(np.array([0]), big[:1], np.array([0, 1, 2]), big)
    assert v == [2, 1] and s == [(1 << 63) - 1] * 2  # told apart by whole numbers, held at the limit


def plain_shingles(text: str, width: int = 5) -> set:
    """Word shingles by definition, without the operator's hashes."""
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", lower)
    return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set()


def plain_groups(texts: dict) -> dict:
    """The smallest id of the group of every text, by comparing all pairs of sets that share a shingle."""
    sets = {i: plain_shingles(t) for i, t in texts.items()}
    meet, root = collections.defaultdict(list), {i: i for i in texts}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, s in sets.items():
        for g in s:
            meet[g].append(i)
    for a, b in {(a, b) for ids in meet.values() for a in ids for b in ids if a < b}:
        both = len(sets[a] & sets[b])
        if 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
            root[max(find(a), find(b))] = min(find(a), find(b))
    return {i: find(i) for i in texts}


def test_pipeline(spark):
    """Each stage on what the one before kept, against plain Python that shares only the fitted weights with it."""
    import corpus_pipeline as c
    from tokenizers import Tokenizer
    from veriframe.llm import packing, quality, toxicity
    from veriframe.llm._common import stage

    d = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    sf = "/root/testdata/sf0.001"
    assert [n for n, _ in c.STAGES] == ["quality", "toxicity", "near_dedup", "packing"] and c.ORACLE_SQL is None
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    texts = {r["doc_id"]: r["text"] for r in d.collect()}
    model = quality.fit(d, labels)
    one = stage(c.keep_good(spark, d, sf), "t")
    mean = {i: sum(model.weights[b] for b in quality.features(t)) / max(len(quality.features(t)), 1) for i, t in texts.items()}
    kept = {i for i, t in texts.items() if not len(quality.features(t)) or mean[i] >= model.threshold}
    assert {r["doc_id"] for r in one.collect()} == kept and len(kept) < len(texts)
    told = {r["doc_id"]: r["quality"] for r in labels.collect()}
    assert sum((told[i] == 1) == (i in kept) for i in texts if i in told) / sum(i in told for i in texts) > 0.9
    two = stage(c.keep_clean(spark, one, sf), "t")
    scorer = toxicity.fit(one, labels)
    assert {r["doc_id"] for r in two.collect()} == {i for i in kept if scorer.score(texts[i])[0] < 0.7}
    three = stage(c.keep_first(spark, two, sf), "t")
    left = {r["doc_id"] for r in two.collect()}
    first = {i for i, root in plain_groups({i: texts[i] for i in left}).items() if i == root}
    assert {r["doc_id"] for r in three.collect()} == first and len(first) < len(left) and three.columns == d.columns
    tok, pieces = Tokenizer.from_file(packing.default_tokenizer()), collections.defaultdict(list)
    for r in c.pack(spark, three, sf).collect():
        pieces[r["doc_id"]].append((r["start"], r["length"], r["ids_crc32"]))
    assert set(pieces) == first
    for i in first:
        ids = np.array([*tok.encode(texts[i] or "", add_special_tokens=False).ids, 2], "<u4")
        at = 0
        for start, n, crc in sorted(pieces[i]):
            assert start == at and crc == zlib.crc32(ids[at : at + n].tobytes())
            at += n
        assert at == len(ids)


def test_keep_first_with_rows_without_ids(spark):
    import corpus_pipeline as c

    base = [f"kata{i}" for i in range(200)]
    near = [*base[:199], "lain"]
    rows = [(5, " ".join(base)), (None, " ".join(near)), (None, "satu dua tiga empat lima enam"), (None, "satu dua tiga empat lima enam"), (3, None), (None, None), (None, "")]
    out = c.keep_first(spark, spark.createDataFrame(rows, "doc_id long, text string"), "")
    got = collections.Counter((r["doc_id"], r["text"]) for r in out.collect())
    assert got[5, rows[0][1]] == 1 and (None, rows[1][1]) not in got and got[None, rows[2][1]] == 1 and got[3, None] == 1
    assert out.schema["doc_id"].dataType.simpleString() == "bigint"


def test_pipeline_on_odd_rows(spark, docs, no_docs):
    import corpus_pipeline as c

    sf = "/root/testdata/sf0.001"
    for d in (docs, no_docs):
        for _, f in c.STAGES[:-1]:
            out = f(spark, d, sf)
            assert out.columns == d.columns
            assert out.count() <= d.count()
    assert c.keep_first(spark, docs, sf).where("doc_id = 7").count() == 1
