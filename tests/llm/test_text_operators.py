import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from tokenizers import Tokenizer

from veriframe.llm import backoff_lm, byte_bpe, components, near_dedup, packing, quality, ring_sharding, toxicity
from veriframe.llm.shingles import shingle_set

RANKS = byte_bpe.load_ranks(P.path("byte_bpe_multi_50k.tiktoken"))
TIKTOKEN = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=RANKS, special_tokens={})


def u32(ids) -> bytes:
    return np.array(ids, "<u4").tobytes()


def test_bpe_round_trip(docs, no_docs, rows):
    got = sorted((r["doc_id"] or -1, r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in byte_bpe.round_trip(docs, RANKS, P.PATTERN, most=200).collect())
    want = []
    for i, t in rows:
        ids = TIKTOKEN.encode_ordinary(t or "")
        want.append((i or -1, len(ids), hashlib.sha256(u32(ids)).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert got == sorted(want)
    assert byte_bpe.round_trip(no_docs, RANKS, P.PATTERN).count() == 0
    ids = byte_bpe.encode_texts(docs.where("doc_id = 54"), byte_bpe.make_encoder(docs, RANKS, P.PATTERN)).first()["ids"]
    assert ids == TIKTOKEN.encode_ordinary("satu")


def test_bpe_fold_and_units(spark):
    from pyspark.sql import functions as F

    words = [" pengujian", "Ünïcödé", "xyzzy123", "日本語", "a", " the", "aaaaaaaaaaaaaaaaaaaa"]
    out = spark.createDataFrame([(w,) for w in words], "w string").select("w", byte_bpe.encode_matches(F.array("w"), RANKS).alias("ids")).collect()
    for r in out:
        assert r["ids"] == TIKTOKEN.encode_ordinary(r["w"])
    rng = random.Random(5)
    marks = [" ", "  ", "\n", "\t", "a", "é", "1", "²", "!", "\x1c", "\x85", "\xa0", "　", "'s", "_", "中", "́", "\r\n", "😀"]
    find = byte_bpe.regex.compile(byte_bpe.plain_pattern(P.PATTERN)).findall
    for _ in range(2000):
        t = "".join(rng.choice(marks) for _ in range(rng.randint(0, 12)))
        found = [m for u in byte_bpe.units(t) for m in find(u)]
        assert "".join(found) == t
        assert b"".join(byte_bpe.merge(m.encode(), RANKS) for m in found) == u32(TIKTOKEN.encode_ordinary(t))


def test_packing(docs, no_docs, rows):
    out = packing.pack(docs, packing.default_tokenizer(), capacity=512).collect()
    tok = Tokenizer.from_file(packing.default_tokenizer())
    want = collections.Counter()
    for i, t in rows:
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 2]
        for at in range(0, len(ids), 512):
            want[i, at, len(ids[at : at + 512]), zlib.crc32(u32(ids[at : at + 512])), len(ids)] += 1
    assert collections.Counter((r["doc_id"], r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in out) == want
    spans = collections.defaultdict(list)
    for r in out:
        spans[r["sequence_id"]].append((r["offset"], r["length"]))
    for s in spans.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= 512
    assert sum(r["length"] for r in out) / (512 * len(spans)) > 0.95
    assert packing.pack(no_docs, packing.default_tokenizer()).count() == 0


def test_packing_is_cost_balanced():
    seq, offset = packing.assign(np.array([10, 10, 10, 1, 1, 1]), 11)
    assert [sorted(np.array([10, 10, 10, 1, 1, 1])[seq == s]) for s in range(3)] == [[1, 10]] * 3
    seq, _ = packing.assign(np.array([6, 6, 6]), 10)
    assert len(set(seq)) == 3


def brute_components(rows, percent=85):
    sets = [shingle_set(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if len(sets[a]) and len(sets[b]):
                both = len(np.intersect1d(sets[a], sets[b]))
                if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                    root[find(a)] = find(b)
    groups = collections.defaultdict(list)
    for i in range(len(rows)):
        groups[find(i)].append(rows[i][0])
    least = {g: min([x for x in ids if x is not None], default=None) for g, ids in groups.items()}
    return collections.Counter((rows[i][0], len(sets[i]), least[find(i)] if len(sets[i]) else rows[i][0]) for i in range(len(rows)))


def test_near_dedup(docs, no_docs, rows):
    out = near_dedup.near_duplicates(docs).collect()
    assert collections.Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in out) == brute_components(rows)
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in out)
    assert near_dedup.near_duplicates(no_docs).count() == 0


def test_near_dedup_crowded_regions(spark, monkeypatch):
    """A large group of near copies, regions of a few rows only: the links found still join all that belong together."""
    monkeypatch.setattr(near_dedup, "REGION", 12)
    rng = random.Random(3)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(60):
        w = list(base)
        w[rng.randrange(120)] = f"z{rng.random()}"
        rows.append((i, " ".join(w)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = near_dedup.near_duplicates(docs).collect()
    want = brute_components(rows)
    got = collections.Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in out)
    assert got == want


def template_family(n: int, copies: int = 0):
    """n texts of one template: every one has one partner at 0.857 and is below 0.85, by 0.001 or 0.01, to all others; copies are the first text but for a word."""
    slots, p = 9, 23
    base = [f"w{i}" for i in range(3 * slots * p + 4)]
    rows = []
    for i in range(n):
        pair, second = divmod(i, 2)
        a, b = divmod(pair, p)
        w = list(base)
        for x in range(slots):  # lines mod p: two texts change at most one slot in common, partners exactly the first
            y = (b + (a + (11 * second)) * x) % p
            w[3 * (x * p + y) + 2] = f"both{pair}" if x == 0 else f"own{i}x{x}"
        rows.append((i, " ".join(w)))
    for i in range(copies):
        w = rows[0][1].split()
        w[30 + 9 * i] = f"copy{i}"
        rows.append((n + i, " ".join(w)))
    return rows


def test_near_dedup_outranked_links(spark):
    """The only link of a row is found however many rows just under the threshold look nearer by signature."""
    rows = template_family(240)
    want = brute_components(rows)
    assert len({c for _, _, c in want}) == 120
    out = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert collections.Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in out) == want


@pytest.mark.parametrize("crowd, words", [(16, 1 << 21), (1 << 20, 20_000)])
def test_near_dedup_crowds_are_compared_whole(spark, monkeypatch, crowd, words):
    """Regions far over REGION rows, blocks far smaller than a crowd (by rows or by shingles), with a large component and many rows outside it."""
    monkeypatch.setattr(near_dedup, "REGION", 16)
    monkeypatch.setattr(near_dedup, "CROWD", crowd)
    monkeypatch.setattr(near_dedup, "CROWD_WORDS", words)
    rows = template_family(80, copies=30)
    want = brute_components(rows)
    assert len({c for _, _, c in want}) == 40
    out = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert collections.Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in out) == want


@pytest.mark.parametrize("n", [600, 3000])
def test_near_dedup_boilerplate(spark, n):
    """Texts of 960 common words: every one has one partner at 0.86, all others are at 0.80."""
    common = [f"w{i}" for i in range(960)]
    shared, own = 40, 78
    rows = [(i, " ".join([*common, *(f"p{i // 2}x{k}" for k in range(shared)), *(f"o{i}x{k}" for k in range(own))])) for i in range(n)]
    a, b, c = (shingle_set(t) for _, t in rows[:3])
    alike = [len(np.intersect1d(a, x)) / len(np.union1d(a, x)) for x in (b, c)]
    assert alike[0] >= 0.85 > alike[1] > 0.79
    out = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    assert {r["doc_id"]: r["component_id"] for r in out} == {i: i - i % 2 for i in range(n)}


@pytest.mark.parametrize("percent", [80, 85])
def test_near_dedup_misses(percent):
    """The chance that a pair just similar enough shares no region, or agrees in fewer values than the floor."""
    p, n = percent / 100, near_dedup.STRIDE * near_dedup.trees(percent)
    below = sum(math.comb(n, k) * p**k * (1 - p) ** (n - k) for k in range(near_dedup.floor(percent)))
    assert below <= near_dedup.FLOOR_MISS and (1 - p**near_dedup.STRIDE) ** near_dedup.trees(percent) <= near_dedup.FOREST_MISS


def test_near_dedup_candidates_stand_side_by_side():
    for n in (2, 8, 9, 1000):
        pairs = list(near_dedup.beside(n))
        assert len(set(pairs)) == len(pairs) and all(0 <= i < j < n for i, j in pairs)
        assert len(pairs) == n * (n - 1) // 2 if n <= near_dedup.SMALL else len(pairs) < near_dedup.BESIDE * n


def test_crowd_counts_with_and_without_a_table(monkeypatch):
    import pyarrow as pa

    sets = [shingle_set(t) for _, t in template_family(20)]
    sig = [near_dedup.MinHash(80)(x).astype("<u4").tobytes() for x in sets]
    for table in (1 << 25, 1):
        monkeypatch.setattr(near_dedup, "_TABLE", table)
        t = pa.table({"block": [0] * 8 + [1] * 12, "tree": [0] * 20, "sig": sig, "group": list(range(20)), "n": [len(x) for x in sets]})
        crowd = near_dedup.Crowd(t, 85)
        assert crowd.open.shape == (8, 12)
        for i, partners, both in crowd.counts(sets):
            assert [len(np.intersect1d(sets[i], sets[j])) for j in partners] == both.tolist()
    t = t.set_column(1, "tree", pa.array([19] * 20))
    assert near_dedup.Crowd(t, 85).open.sum() < crowd.open.sum()  # pairs that met in an earlier order


def test_shingles_by_definition():
    import re

    def brute(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t))
        return len({tuple(w[i : i + 3]) for i in range(len(w) - 2)}) if len(w) >= 3 else len(w) > 0

    for t in ("", " ", "A", "a B", "a b a b a b", "Ä ä Ä ä", "x y z\x0bq w", "one Two three\x85four five"):
        assert len(shingle_set(t)) == brute(t)
    assert (shingle_set("Satu DUA tiga") == shingle_set("satu dua\ttiga")).all()


def test_components(spark):
    links = [(i, i + 1) for i in range(30)] + [(100, 101), (200, 200), (101, 102)]
    out = {r["id"]: r["component"] for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert out == {i: 0 for i in range(31)} | {100: 100, 101: 100, 102: 100}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_sharding(docs, no_docs, rows):
    out = ring_sharding.shard_documents(docs, 4).collect()
    want = collections.Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows)
    assert collections.Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in out) == want
    slots = collections.defaultdict(list)
    for r in out:
        slots[r["shard"]].append(r["slot"])
    sizes = [len(s) for s in slots.values()]
    assert len(slots) == 4 and max(sizes) - min(sizes) <= 1 and all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert ring_sharding.shard_documents(no_docs).count() == 0


def test_ring_moves_little():
    rng = random.Random(1)
    counts = collections.Counter(rng.randrange(ring_sharding.CELLS) for _ in range(20000))
    where = []
    for n in (16, 17):
        at = {}
        for cell, lo, hi, shard, _ in ring_sharding.seat(dict(counts), n, 64):
            at.update({(cell, r): shard for r in range(lo, hi)})
        assert len(at) == 20000
        where.append(at)
    moved = sum(where[0][k] != where[1][k] for k in where[0])
    assert moved < 0.35 * 20000  # a plain modulus would move 94 %


def test_ring_owner_is_next_clockwise():
    at = {}
    for shard in range(3):
        for v in range(5):
            place = int.from_bytes(hashlib.sha256(f"shard-{shard}/vnode-{v}".encode()).digest()[:8], "big") % ring_sharding.CELLS
            at[place] = min(shard, at.get(place, shard))
    owners = ring_sharding.ring_owners(3, 5)
    for cell in [*at, *(p + 1 for p in at), 0, ring_sharding.CELLS - 1]:
        cell %= ring_sharding.CELLS
        walk = next(p for p in [*sorted(p for p in at if p >= cell), min(at)])
        assert owners[cell] == at[walk], cell


def brute_ring(rows, n_shards, vnodes):
    """Shard by (cell, rank in the cell): own shard while it has room, else the next node clockwise whose shard has."""
    owners = ring_sharding.ring_owners(n_shards, vnodes)
    room = [len(rows) // n_shards + (s < len(rows) % n_shards) for s in range(n_shards)]
    out, over = {}, []
    for cell, rank in sorted(rows):
        if room[owners[cell]]:
            room[owners[cell]] -= 1
            out[cell, rank] = owners[cell]
        else:
            over.append((cell, rank))
    for cell, rank in over:
        c = (cell + 1) % ring_sharding.CELLS
        while owners[c] == owners[c - 1] or not room[owners[c]]:
            c = (c + 1) % ring_sharding.CELLS
        room[owners[c]] -= 1
        out[cell, rank] = owners[c]
    return out


def test_ring_seats_against_one_key_at_a_time():
    rng = random.Random(4)
    cells = [rng.randrange(ring_sharding.CELLS) for _ in range(600)] + [77] * 300
    counts = collections.Counter(cells)
    got = {(cell, r): shard for cell, lo, hi, shard, _ in ring_sharding.seat(dict(counts), 5, 8) for r in range(lo, hi)}
    assert got == brute_ring([(c, r) for c, n in counts.items() for r in range(n)], 5, 8)


def test_sharding_places_and_hot_keys(spark, monkeypatch):
    monkeypatch.setattr(ring_sharding, "HOT_ROWS", 50)
    rows = [(i, f"teks {i}") for i in range(500)] + [(7, "sama")] * 400 + [(None, "tanpa")] * 200
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    out = ring_sharding.shard_documents(docs, 4).collect()
    assert collections.Counter((r["doc_id"], r["size"]) for r in out) == collections.Counter((i, len(t) + 1) for i, t in rows)
    slots = collections.defaultdict(list)
    for r in out:
        slots[r["shard"]].append(r["slot"])
    assert {len(s) for s in slots.values()} == {275} and all(sorted(s) == list(range(275)) for s in slots.values())
    plain = spark.createDataFrame(rows[:500], "doc_id long, text string")
    cell = {r["doc_id"]: (r["c"], r["h"]) for r in plain.selectExpr("doc_id", "cast(shiftrightunsigned(xxhash64(doc_id), 48) as int) c", "xxhash64(doc_id) h").collect()}
    ranks, order = {}, sorted(cell, key=lambda i: cell[i])
    for i in order:
        ranks[i] = (cell[i][0], sum(cell[j][0] == cell[i][0] and cell[j][1] < cell[i][1] for j in order))
    want = brute_ring(list(ranks.values()), 4, 64)
    assert all(want[ranks[r["doc_id"]]] == r["shard"] for r in ring_sharding.shard_documents(plain, 4).collect())


def edit_distance(a: str, b: str) -> int:
    d = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        d, last = [i], d
        for j, y in enumerate(b, 1):
            d.append(min(d[-1] + 1, last[j] + 1, last[j - 1] + (x != y)))
    return d[-1]


def test_automaton_against_edit_distance():
    terms = [("pathetic", False, 1.0), ("worthless", False, 1.0), ("scum", False, 1.0), ("lowei", True, 1.0), ("abcdefgh", True, 1.0)]
    a = toxicity.Automaton(terms)
    rng = random.Random(2)
    for term, stem, _ in terms:
        for _ in range(300):
            w = list(term)
            for _ in range(rng.randint(0, 3)):
                k = rng.randrange(1, len(w))
                w[k : k + rng.randint(0, 1)] = rng.choice(("", "x", "e", "th"))
            word = "".join(w) + ("ung" if stem else "")
            want = min((edit_distance(word[:k], t) for t, s, _ in terms for k in (range(1, len(word) + 1) if s else [len(word)]) if word[0] == t[0] and edit_distance(word[:k], t) <= a.allowed(t, s)), default=None)
            got = a.match(word)
            assert (got[0] if got else None) == want, word


def test_words_keep_their_edits_beside_stems():
    rows = [("idio", True, 90, 0), ("idiot", True, 80, 0), ("idiot", False, 70, 0), ("worthless", False, 50, 0), ("wort", True, 60, 1)]
    terms = toxicity.choose(rows, 100, 100)
    assert {(t, s) for t, s, _ in terms} == {("idio", True), ("idiot", False), ("wort", True), ("worthless", False)}
    a = toxicity.Automaton(terms)
    assert [a.match(w) and a.match(w)[0] for w in ("idiot", "idiots", "idxot", "wxrthlss", "ixxot")] == [0, 0, 1, 2, None]


def test_quotation():
    t = 'he said "you idiot" to them'
    assert toxicity.quotation(t, t.index("idiot"), t.index("idiot") + 5) == 1.0
    assert toxicity.quotation("you idiot", 4, 9) == 0.0


def toxic_docs(spark, n=800):
    from .conftest import prose

    docs, labels = [], []
    for i in range(n):
        t = prose(i + 1000).split()
        if i % 4 == 0:
            t[5], t[40], t[70] = random.Random(i).choice(["kampret", "kampretz", "bangsatlah", "bangsatnya"]), "bangsatkah", "kampret"
        docs.append((i, " ".join(t)))
        labels.append((i, 1, int(i % 4 == 0)))
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_toxicity(spark, docs, no_docs, rows):
    d, labels = toxic_docs(spark)
    model = toxicity.fit(d, labels)
    out = {r["doc_id"]: r for r in toxicity.score_documents(d, model).collect()}
    for i, r in out.items():
        assert r["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1)
        assert r["predicted"] == int(r["score"] >= 0.7) == int(i % 4 == 0)
    odd = toxicity.score_documents(docs, model).collect()
    assert len(odd) == len(rows) and all(0 <= r["score"] <= 1 and r["predicted"] == 0 for r in odd)
    assert toxicity.score_documents(no_docs, model).count() == 0
    nothing = toxicity.fit(d, labels.where("toxic = 0"))
    assert toxicity.score_documents(d, nothing).where("predicted = 1").isEmpty()
    assert toxicity.keep_clean(docs, model).count() == len(rows) and toxicity.keep_clean(docs, model).columns == docs.columns


def plain_toxic_features(text: str, terms: list) -> tuple[list, int]:
    """Features of a text by edit distances to every term, term by term and word by word."""

    def closest(word: str):
        found = []
        for t, (term, stem, _) in enumerate(terms):
            most = int(len(term) >= 7) if stem else int(len(term) >= 5) + int(len(term) >= 9)
            forms = [word[:k] for k in range(1, len(word) + 1)] if stem else [word]
            edits = min(edit_distance(f, term) for f in forms)
            if word[0] == term[0] and edits <= most:
                found.append((edits, t))
        return min(found, default=None)

    low = text.lower()
    places = [(m.start(), m.end()) for m in re.finditer(r"[^\W_]+", low)]
    hits = [(closest(low[a:b]), toxicity.quotation(low, a, b)) for a, b in places]
    hits = [(h, q) for h, q in hits if h]
    exact = [(h[1], q) for h, q in hits if h[0] == 0]
    if not hits:
        return [1, 0, 0, 0, 0, 0, 0], 0
    abuse, fuzzy, quoted = sum(1 - q for _, q in exact), sum(1 - q for h, q in hits if h[0]), sum(q for _, q in hits)
    log1p, odds = math.log1p, max([terms[t][2] for t, _ in exact], default=0)
    return [1, log1p(abuse), log1p(fuzzy), log1p(quoted), log1p(100 * abuse / len(places)), log1p(len({t for t, _ in exact})), max(odds, 0)], len(hits)


def test_toxic_features_against_edit_distances():
    terms = [("kampret", False, 2.0), ("bangsat", True, 3.5), ("goblokkah", False, 1.5), ("anji", True, 2.5), ("anjing", False, 0.5)]
    rng, said = random.Random(5), ['"', "\u201c", "\u201d", " said ", " kata ", ", ", ". "]
    words = ["kampret", "kamprit", "bangsatlah", "bxngsatnya", "goblkkaah", "anjingan", "anxing", "rumah", "di", "bang", "KAMPRET", "satu_dua"]
    scorer = toxicity.Scorer(terms, np.array([-1.0, 0.5, 0.4, -0.3, 0.2, 0.6, 0.7]))
    for _ in range(150):
        text = "".join(rng.choice(words) + (rng.choice(said) if rng.random() < 0.3 else " ") for _ in range(rng.randint(0, 30)))
        want, n = plain_toxic_features(text, terms)
        got, hits = scorer.features(text)
        assert hits == n and np.allclose(got, want), text
        assert math.isclose(scorer.score(text)[0], 1 / (1 + math.exp(-float(np.dot(want, scorer.weights)))))


def test_toxic_lexicon_and_weights_made_anew(spark):
    d, labels = toxic_docs(spark, 300)
    model = toxicity.fit(d, labels)
    text = {r["doc_id"]: r["text"] for r in d.collect()}
    toxic = {r["doc_id"]: r["toxic"] for r in labels.collect() if zlib.crc32(str(r["doc_id"]).encode()) % 3 != 1}
    n, seen = collections.Counter(toxic.values()), {0: collections.Counter(), 1: collections.Counter()}
    for i, y in toxic.items():
        words = {w for w in re.findall(r"[^\W_]+", text[i].lower()) if 3 <= len(w) <= 30}
        seen[y].update({(w, False) for w in words} | {(w[:k], True) for w in words for k in range(4, 8) if k < len(w)})
    least = max(3, round(0.002 * n[1]))
    odd = {g for g, c in seen[1].items() if c >= least and (c + 0.5) / n[1] >= 25 * (seen[0][g] + 0.5) / n[0]}
    kept = {(g, stem) for g, stem in odd if not (stem and any((g[:k], True) in odd for k in range(4, len(g))))}
    want = {(*g, math.log((seen[1][g] + 0.5) / (n[1] + 1)) - math.log((seen[0][g] + 0.5) / (n[0] + 1))) for g in kept}
    assert {(t, s, round(o, 9)) for t, s, o in model.terms} == {(t, s, round(o, 9)) for t, s, o in want} and want
    x, y = np.array([plain_toxic_features(text[i], model.terms)[0] for i in toxic], float), np.array(list(toxic.values()), float)
    slope = x.T @ (y - 1 / (1 + np.exp(-x @ model.weights))) - 0.1 * model.weights
    assert np.abs(slope).max() < 1e-5  # the ridge likelihood is concave: no slope, no better weights


def quality_docs(spark, n=200):
    from .conftest import prose

    bad = lambda t: " ".join(w + random.Random(len(w)).choice(("###", "&&&", "***")) for w in t.split())
    docs = [(i, bad(prose(i)) if i % 5 == 0 else prose(i)) for i in range(n)]
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(i, int(i % 5 > 0), 0) for i in range(0, n, 2)], "doc_id long, quality int, toxic int")


def test_quality(spark, docs, no_docs, rows):
    d, labels = quality_docs(spark)
    model = quality.fit(d, labels)
    out = quality.resample(quality.rate(d, model), 0.5)
    got = out.collect()
    assert all(r["accepted"] == (r["doc_id"] % 5 > 0) for r in got)
    assert sum(r["sampled"] for r in got) == 100
    assert quality.keep_good(docs, model).columns == docs.columns and quality.rate(docs, model).count() == len(rows)
    assert quality.rate(no_docs, model).count() == 0 and quality.resample(quality.rate(no_docs, model)).count() == 0
    free = quality.fit(no_docs, labels)
    assert quality.keep_good(docs, free).count() == len(rows)


def test_quality_numbers_against_plain_python(spark):
    """Counts, log ratios, threshold, noise and the sampled rows are made anew from the features."""
    d, labels = quality_docs(spark)
    model = quality.fit(d, labels)
    texts = {r["doc_id"]: r["text"] for r in d.collect()}
    raw, target = collections.Counter(), collections.Counter()
    for i, t in texts.items():
        f = quality.features(t).tolist()
        raw.update(f)
        if i % 2 == 0 and i % 5 > 0:
            target.update(f)
    n_raw, n_target = sum(raw.values()), sum(target.values())
    for b in range(0, quality.BUCKETS, 97):
        p = (raw[b] + 1) / (n_raw + quality.BUCKETS)
        assert math.isclose(model.weights[b], math.log((target[b] + 50 * p) / (n_target + 50) / p), abs_tol=1e-9)
    out = {r["doc_id"]: r for r in quality.resample(quality.rate(d, model), 0.3).collect()}
    keys = {}
    for i, t in texts.items():
        f = quality.features(t)
        total, u = sum(model.weights[f]), ((__import__("xxhash").xxh64_intdigest(str(i), 0) >> 11) + 0.5) / 2**53
        keys[i] = total / len(f) * math.sqrt(len(f)) - math.log(-math.log(u))
        assert math.isclose(out[i]["gumbel_key"], keys[i], abs_tol=1e-9) and out[i]["accepted"] == (total / len(f) >= model.threshold)
    best = sorted(keys, key=lambda i: -keys[i])[:60]
    assert {i for i, r in out.items() if r["sampled"]} == set(best)


def test_quality_ties_and_missing_ids(spark):
    d, labels = quality_docs(spark)
    odd = spark.createDataFrame([(None, f"kata {i} lain") for i in range(50)] + [(9000, "kata sama saja")] * 30 + [(9001, None), (9002, "")], "doc_id long, text string")
    rated = quality.rate(odd, quality.fit(d, labels)).collect()
    assert len({r["gumbel"] for r in rated if r["doc_id"] is None}) == 50
    assert len({r["gumbel"] for r in rated if r["doc_id"] == 9000}) == 1
    assert all(r["accepted"] and r["n_features"] == 0 for r in rated if r["doc_id"] in (9001, 9002))
    for fraction in (0.1, 0.5, 0.9):
        out = quality.resample(spark.createDataFrame(rated), fraction).collect()
        keys = sorted((r["gumbel_key"] for r in out), reverse=True)
        kth = keys[math.ceil(len(out) * fraction) - 1]
        assert all(r["sampled"] == (r["gumbel_key"] >= kth) for r in out)


def test_kth_largest(spark):
    rng = np.random.default_rng(4)
    v = np.concatenate([rng.standard_normal(500) * 1e6, rng.standard_normal(500), [3.0] * 50])
    df = spark.createDataFrame([(float(x),) for x in v], "x double")
    for k in (1, 7, 500, 1049):
        assert quality.kth_largest(df, "x", k) == np.sort(v)[::-1][k - 1]


def test_backoff(docs, no_docs, rows, monkeypatch):
    monkeypatch.setattr(backoff_lm, "BLOCK_WORDS", 3000)
    text = [(i, (t or "").encode().lower().split()) for i, t in rows]
    uni, bi = collections.Counter(), collections.Counter()
    for _, w in text:
        uni.update(w)
        bi.update(zip(w, w[1:]))
    total, want = sum(uni.values()), []
    for i, w in text:
        u, b, s, found = collections.Counter(w), collections.Counter(zip(w, w[1:])), 0.0, 0
        for k, x in enumerate(w):
            alone = (uni[x] - u[x] or 0.4) / max(total - len(w), 1)
            if k:
                pair = bi[w[k - 1], x] - b[w[k - 1], x]
                found += pair > 0
                alone = pair / max(uni[w[k - 1]] - u[w[k - 1]], 1) if pair else 0.4 * alone
            s += math.log10(alone)
        want.append((i or -1, len(w), found, round(s, 4)))
    got = backoff_lm.score(docs).collect()
    assert sorted((r["doc_id"] or -1, r["n_words"], r["pairs_found"], round(r["log10_score"], 4)) for r in got) == sorted(want)
    assert all((r["mean_log10"] is None) == (r["n_words"] == 0) for r in got)
    assert backoff_lm.score(no_docs).count() == 0


def test_frequent_counts_survive_bytes():
    small, large = np.array([3, 255, 255], np.uint8), np.array([255, 70000], "<u8")
    assert backoff_lm._widen(small.tobytes(), large.tobytes()).tolist() == [3, 255, 70000]


@pytest.mark.parametrize("n", [0, 1, 1000])
def test_numbers_pack(n):
    flat = np.random.default_rng(n).integers(0, 50, n).astype(np.uint64)
    vocabulary, packed = backoff_lm.number_words(flat)
    assert (vocabulary[backoff_lm.unpack_numbers(packed, n)] == flat).all()
