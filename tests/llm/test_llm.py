"""Small cases of every operator: nulls, empty and long texts, ties, repeated rows, empty tables, clashing
columns; and each held against a brute-force version."""

import collections
import datetime
import hashlib
import itertools
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from glyphmill.llm import chat_format, fingerprints, mixing, near_dedup, pii, sentencepiece_codec, sharding, token_counts, topk, toxicity
from glyphmill.llm.components import connected_components

from ..conftest import SF

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omikron pi rho sigma tau".split()


def odd_docs(spark):
    """Null ids, texts and sources, an empty and a long text, ties, repeated rows, clashing columns."""
    rows = [
        (1, "one two three", "a"), (2, None, "b"), (3, "", None), (None, "no id", "a"), (5, "same text here now", "a"), (6, "same text here now", "b"),
        (7, "twice", "a"), (7, "twice", "a"), (8, " \t\n", "c"), (9, "lang " * 40_000, "a"), (-4, "é😀 ünï", None),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    return df.withColumns({c: F.lit("clash") for c in ("shard", "slot", "score", "predicted", "size", "target", "taken", "n_tokens", "n_replaced", "piece_ids", "decoded", "kept")})


def empty(spark):
    return odd_docs(spark).limit(0)


# -- 1 sharding


@pytest.mark.parametrize("n", [0, 1, 39, 40, 41, 1000])
def test_shards_are_even_and_slots_gapless(spark, n):
    rows = sharding.assign_shards(spark.range(n).withColumnRenamed("id", "k"), "k", 40, 16).collect()
    assert len(rows) == n and {r.k for r in rows} == set(range(n))
    sizes = [sum(r.shard == s for r in rows) for s in range(40)]
    assert max(sizes) - min(sizes) <= 1
    for s in range(40):
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sizes[s]))


def test_shards_follow_a_walk_around_the_ring(spark):
    """Most keys lie where the ring says, the others are as few as the capacities allow."""
    n, shards, nodes = 3000, 7, 8
    df = spark.range(n).withColumnRenamed("id", "k")
    ring = {r.cell: r.home for r in sharding.ring(spark, shards, nodes).collect()}
    assert len(ring) == sharding.CELLS
    got = sharding.assign_shards(df, "k", shards, nodes).select("k", "shard", F.pmod(F.shiftright(F.xxhash64(F.lit("key"), "k"), 20), F.lit(sharding.CELLS)).alias("cell")).collect()
    homes = [ring[r.cell] for r in got]
    surplus = sum(max(0, homes.count(s) - (n // shards + (s < n % shards))) for s in range(shards))
    assert sum(h != r.shard for h, r in zip(homes, got, strict=True)) == surplus


def test_growing_the_ring_moves_few_rows(spark):
    df = spark.range(4000).withColumnRenamed("id", "k")
    a, b = ({r.k: r.shard for r in sharding.assign_shards(df, "k", s, 64).collect()} for s in (40, 41))
    assert sum(a[k] != b[k] for k in a) < 0.35 * len(a)  # dealt by remainder 39 in 40 would move


def test_shard_query_equals_its_contract(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = sharding.op1_sharding(spark, SF).collect()
    assert {r.doc_id for r in rows} == set(docs) and len(rows) == len(docs)
    shards = collections.defaultdict(list)
    for r in rows:
        raw = (docs[r.doc_id] or "").encode()
        assert (r["size"], r.text_crc32, r.law, r.grown_shard) == (len(raw) + 16, zlib.crc32(raw), "rows", None)
        shards[r.shard].append(r.slot)
    assert set(shards) == set(range(40)) and all(sorted(x) == list(range(len(x))) for x in shards.values())
    assert max(map(len, shards.values())) - min(map(len, shards.values())) <= 1


def test_shards_of_odd_rows(spark):
    rows = sharding.assign_shards(odd_docs(spark), "doc_id", 3, 4).collect()
    assert len(rows) == 11 and {r.shard for r in rows} <= {0, 1, 2} and sharding.assign_shards(empty(spark), "doc_id").count() == 0


# -- 2 toxicity


def test_noisy_or_learns_words_and_finds_sentences(spark):
    rnd = random.Random(3)
    texts, labels = [], []
    for i in range(400):
        parts = [" ".join(rnd.choices(WORDS, k=6)) for _ in range(5)]
        if i % 4 == 0:
            parts[i % 5] += " " + rnd.choice(["badword", "badwordish", "nasty"])
        texts.append(". ".join(parts))
        labels.append(int(i % 4 == 0))
    docs = spark.createDataFrame(list(enumerate(texts[:300])), "doc_id long, text string")
    known = spark.createDataFrame(list(enumerate(labels[:300])), "doc_id long, toxic int")
    model = toxicity.train(docs, known)
    assert [int(model.score(t)[0] >= 0.5) for t in texts[300:]] == labels[300:]
    p, at, worst = model.score("alpha beta. you badword thing. gamma")
    assert p >= 0.5 and at == 1 and worst > 0.4
    assert 0 <= model.score("")[0] < 0.1


def test_toxicity_of_odd_rows(spark):
    labels = spark.createDataFrame([(1, None), (None, 1), (5, 1), (5, 0), (99, 1), (6, 0)], "doc_id long, toxic int")
    model = toxicity.train(odd_docs(spark), labels)
    rows = toxicity.score_documents(odd_docs(spark), model).collect()
    assert len(rows) == 11 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    assert toxicity.score_documents(empty(spark), toxicity.train(empty(spark), labels.limit(0))).count() == 0


def test_training_of_long_and_repeated_texts(spark):
    ids = [i for i in range(1, 200) if zlib.crc32(str(i).encode()) % 5]
    rows = [(i, "alpha beta. you badword thing" if i % 3 == 0 else "alpha beta. gamma thing") for i in ids]
    known = spark.createDataFrame([(i, int(i % 3 == 0)) for i in ids], "doc_id long, toxic int")
    df = lambda r: spark.createDataFrame(r, "doc_id long, text string")
    plain = toxicity.train(df(rows), known, chars_bound=80_000)
    assert plain.score("a badword")[0] >= 0.5 > plain.score("alpha beta. gamma")[0]
    repeated = toxicity.train(df(rows + rows[:50]), known, chars_bound=80_000)
    assert repeated.weights == plain.weights and repeated.bias == plain.bias
    long = toxicity.train(df([(ids[0], "x " * 50_000), *rows[1:]]), known, chars_bound=80_000)  # it alone is left out
    assert long.score("a badword")[0] >= 0.5 > long.score("alpha beta. gamma")[0]
    with pytest.raises(ValueError, match="no labelled"):
        toxicity.train(df([(ids[0], "x " * 50_000)]), known, chars_bound=80_000)


def test_toxicity_query_holds_on_rows_held_out(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    rows = {r.doc_id: r for r in toxicity.op2_toxicity(spark, "/root/testdata/sf0.01").collect()}
    assert set(rows) == set(docs)
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and (r.worst_sentence or "") in (docs[i] or "") for i, r in rows.items())
    labels = [(rows[r.doc_id].score, r.toxic) for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect() if r.toxic is not None and rows[r.doc_id].held_out]
    toxic, clean = [s for s, y in labels if y], [s for s, y in labels if not y]
    assert np.mean([(s > c) + (s == c) / 2 for s in toxic for c in clean]) > 0.85 and np.mean([c < 0.5 for c in clean]) > 0.9


# -- 3 near duplicates


def brute_components(rows, k, threshold):
    sets = {}
    for i, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(sorted(sets), 2):
        both = len(sets[a] & sets[b])
        if both and Fraction(both, len(sets[a] | sets[b])) >= threshold:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in sets}


def test_near_duplicates_equal_brute_force(spark):
    rnd = random.Random(5)
    rows = []
    for group in range(12):
        base = rnd.choices(WORDS, k=60) + [f"g{group}w{j}" for j in range(40)]
        for copy in range(12):
            words = list(base)
            for _ in range(rnd.randrange(0, 9)):
                words[rnd.randrange(len(words))] = f"edit{rnd.randrange(1000)}"
            rows.append((len(rows) * 3 + 1, " ".join(words)))
        rows += [(len(rows) * 3 + 1, rows[-1][1]) for _ in range(2)]
    rows = [(i, t) for n, (i, t) in enumerate(rows)]
    rows = [(n * 3 + 1, t) for n, (_, t) in enumerate(rows)]
    rnd.shuffle(rows)
    for k, threshold in ((3, Fraction(85, 100)), (5, Fraction(8, 10))):
        got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), k, threshold).collect()
        assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute_components(rows, k, threshold)
        assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_near_duplicates_of_odd_rows(spark):
    rows = near_dedup.near_duplicates(odd_docs(spark)).collect()
    assert len(rows) == 11
    by = {r.doc_id: r for r in rows}
    assert by[6].component_id == 5 and not by[6].kept and by[2].n_shingles == by[3].n_shingles == by[8].n_shingles == 0 and by[8].kept
    assert by[None].component_id is None and by[None].kept and by[9].n_shingles == 1
    left = near_dedup.keep_one(odd_docs(spark))
    assert sorted(str(r.doc_id) for r in left.collect()) == sorted(["1", "2", "3", "None", "5", "7", "8", "9", "-4"]) and left.columns == odd_docs(spark).columns
    assert near_dedup.near_duplicates(empty(spark)).count() == near_dedup.keep_one(empty(spark)).count() == 0


def test_components(spark):
    rnd = random.Random(1)
    edges = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(1000, 1040)] + [(2000, 2000 + i) for i in range(1, 50)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    root = {}
    for a, b in edges:
        if a != b:
            root.setdefault(a, a), root.setdefault(b, b)
    for _ in range(60):
        for a, b in edges:
            if a != b:
                root[a] = root[b] = min(root[a], root[b])
    assert got == root
    assert connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


# -- 4 mixing


def test_targets_and_positions(spark):
    rows = [(i, f"s{i % 5}" if i % 7 else None, 1 + i * i % 50) for i in range(2000)] + [(5000 + i, "tiny", 3) for i in range(2)]
    df = spark.createDataFrame(rows, "doc_id long, source string, words long")
    mixed = mixing.mix(df, size=F.col("words")).collect()
    assert len(mixed) == len(rows)
    totals = {}
    for r in mixed:
        t = totals.setdefault(r.source, [r.target, r.source_size, 0])
        t[2] += r.taken
        assert r.repeats == len(r.positions) and r.taken == r.repeats * r.words and list(r.positions) == sorted(r.positions) and all(0 <= p <= 1 for p in r.positions)
    everything = sum(r[2] for r in rows)
    assert abs(sum(t[0] for t in totals.values()) - 1.5 * everything) < 1e-6 * everything
    assert all(abs(t[2] - t[0]) <= 25 and t[0] <= 2 * t[1] for t in totals.values())
    names = sorted((s for s in totals if s), key=str) + [None]
    level = [totals[s][0] / (5, 2, 1)[i % 3] for i, s in enumerate(names) if totals[s][0] < 2 * totals[s][1]]
    assert max(level) - min(level) < 1e-6
    assert sorted(map(tuple, mixed)) == sorted(map(tuple, mixing.mix(df.repartition(5), size=F.col("words")).collect())) if all(r.source for r in mixed) else True
    order = [r.position for r in mixing.training_order(mixing.mix(df, size=F.col("words"))).collect()]
    assert order == sorted(order) and len(order) == sum(r.repeats for r in mixed)


def test_position_inverts_the_schedule(spark):
    for c, (a, b) in enumerate(mixing.SCHEDULES):
        times = [i / 20 for i in range(21)]
        offsets = [(a * t + (b - a) * t * t / 2) / ((a + b) / 2) * 1000 for t in times]
        df = spark.createDataFrame([(o,) for o in offsets], "o double").select(mixing.position(F.col("o"), F.lit(1000.0), F.lit(c)).alias("t"))
        assert np.allclose([r.t for r in df.collect()], times)


def test_mixing_odd_rows(spark):
    rows = mixing.mix(odd_docs(spark)).collect()
    assert len(rows) == 11 and {r.doc_id: r.size for r in rows}[9] == 40_000 and mixing.mix(empty(spark)).count() == 0


# -- 5 pieces


def test_pieces_equal_the_library(spark):
    sentencepiece = pytest.importorskip("sentencepiece")
    import public_tokenizers

    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(sentencepiece_codec.MODEL))
    rnd = random.Random(2)
    texts = ["", " ", "a  b   c", "x\n\ny\t", "é😀 ünï", "\x00", "ab" * 500, "▁ literal", "  lead"] + [
        "".join(chr(rnd.choice([rnd.randrange(32, 127), rnd.randrange(32, 1500), rnd.randrange(0x3040, 0x5000)])) for _ in range(50)) for _ in range(200)
    ]
    model = sentencepiece_codec.load(sentencepiece_codec.MODEL)
    ours = [x.tolist() for x in model.encode(texts)]
    assert ours == library.encode(texts) and [model.decode(x) for x in ours] == [library.decode(x) for x in ours]
    rows = sentencepiece_codec.op5_sentencepiece(spark, SF).collect()
    assert all(r.round_trip and r.n_pieces == len(r.piece_ids) for r in rows)
    odd = sentencepiece_codec.decode(sentencepiece_codec.encode(odd_docs(spark))).collect()
    assert len(odd) == 11 and all(r.decoded == (r.text or "") for r in odd)
    assert sentencepiece_codec.decode(sentencepiece_codec.encode(empty(spark))).count() == 0


def test_suffix_array():
    rnd = np.random.default_rng(1)
    text = rnd.integers(1, 4, 300).astype(np.uint8)
    order = sentencepiece_codec.suffix_array(text, 400)
    raw = text.tobytes()
    assert [raw[i:] for i in order] == sorted(raw[i:] for i in range(300))


# -- 6 top-k


@pytest.mark.parametrize("low, high, dim", [(-50, 50, 8), (0, 2, 3), (-(1 << 40), 1 << 40, 4)])
def test_top_k_equals_brute_force(spark, low, high, dim, monkeypatch):
    monkeypatch.setattr(topk, "SHARD_ROWS", 100)
    monkeypatch.setattr(topk, "BLOCK_QUERIES", 7)
    rnd = random.Random(dim)
    rows = [(i, [rnd.randrange(low, high) for _ in range(dim)]) for i in range(450)] + [(450 + i, [1] * dim) for i in range(150)]
    df = spark.createDataFrame(rows, "vec_id long, vector array<long>")
    got = topk.top_k(df, df.where("vec_id % 20 = 0"), 5).collect()
    want = set()
    for q, v in rows:
        if q % 20 == 0:
            best = sorted(((-max(-(1 << 63), min((1 << 63) - 1, sum(a * b for a, b in zip(v, w, strict=True)))), i) for i, w in rows if i != q))[:5]
            want |= {(q, r + 1, i, -s) for r, (s, i) in enumerate(best)}
    assert {tuple(r) for r in got} == want


def test_top_k_of_odd_rows(spark):
    rows = [(1, [0.5, 1.0]), (2, None), (3, [float("nan"), 1.0]), (4, [None, 1.0]), (5, [-0.25, 0.5]), (5, [-0.25, 0.5]), (None, [1.0, 1.0]), (6, [1.0]), (7, [float("inf"), 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").select("vec_id", topk.to_integers(F.col("embedding")).alias("vector"))
    assert sorted(map(tuple, topk.top_k(df, df).collect())) == [(1, 1, 5, 512 * -256 + 1024 * 512), (5, 1, 1, 512 * -256 + 1024 * 512)]
    assert topk.top_k(df.limit(0), df.limit(0)).count() == 0


# -- 7 chat


def test_chat_round_trip(spark):
    rnd = random.Random(4)
    bits = ["\\", "#", "###", "</turn>", "</turn>\n", "\\h", "\\e", " (again)", ": ", "### assistant: ", "word", "é😀", "\n", "", "\\\\#"]
    rows = [(c, t, rnd.choice(["user", "assistant", "system", "a: (again)", "\\c(", None]), rnd.choice([None, "".join(rnd.choices(bits, k=rnd.randrange(30)))])) for c in range(40) for t in range(rnd.randrange(1, 12))]
    rows += [(90, t, "system" if t == 0 else "assistant", "long words " * 300) for t in range(5)] + [(None, 1, "user", "x"), (91, None, "user", "y"), (91, 1, "user", "z"), (91, 1, "user", "z")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit("clash"))
    for budget, history in ((60, 20), (1024, 128), (1, 0)):
        got = {r.conv_id: r for r in chat_format.read_back(chat_format.format_windows(df, budget, history)).collect()}
        for c in {r[0] for r in rows}:
            own = sorted((r for r in rows if r[0] == c), key=lambda r: (r[1] is None, r[1] or 0, r[2] or "", r[3] or ""))
            assert [(t.role, t.text) for t in got[c].turns] == [(r[2] or "", r[3] or "") for r in own]
            assert list(got[c].learnt) == [r[3] or "" for r in own if r[2] == "assistant"]
    windows = chat_format.format_windows(df, 60, 20).where("conv_id = 90").collect()
    assert len(windows) == 5 and all(w.over_budget for w in windows) and all(w.formatted.startswith("### system") for w in windows)
    assert all(w.n_tokens <= 1024 for w in chat_format.format_windows(df, 1024, 128).where("not over_budget").collect())
    assert chat_format.read_back(chat_format.format_windows(df.limit(0))).count() == 0


def test_long_chat_in_chunks(spark):
    """A conversation over several chunks and buckets, with gaps: windows as a plain walk over each chunk makes them."""
    rnd = random.Random(5)
    for lead in (True, False):
        texts = [("system" if lead and i == 0 else rnd.choice(["user", "assistant"]), "x" * rnd.randrange(60)) for i in range(137)]
        df = spark.createDataFrame([(1, i * 97 - 500, *t) for i, t in enumerate(texts)], "conv_id long, turn long, role string, text string")
        budget, history, chunk = 100, 24, 20
        cost = [-(-len(t) // 4) + 4 for _, t in texts]
        system = cost[0] if lead else 0
        expected = []
        for c in range(0, len(texts), chunk):
            at, room = c, budget - system - history
            while at < min(c + chunk, len(texts)):
                stop = at + 1
                while stop < min(c + chunk, len(texts)) and sum(cost[at : stop + 1]) <= room:
                    stop += 1
                back = at
                while back - 1 >= lead and sum(cost[back - 1 : at]) <= history:
                    back -= 1
                repeated = ([texts[0]] if lead and at else []) + texts[back:at]
                written = "".join(f"### {r} (again): {t}</turn>\n" for r, t in repeated) + "".join(f"### {r}: {t}</turn>\n" for r, t in texts[at:stop])
                expected.append((at, written, sum(cost[back:stop]) + (system if at else 0)))
                at = stop
        windows = chat_format.format_windows(df.repartition(5), budget, history, chunk)
        assert sorted((w.window, w.formatted, w.n_tokens) for w in windows.collect()) == expected
        assert [tuple(t) for t in chat_format.read_back(windows).first().turns] == texts


def test_chat_query(spark):
    """Every conversation's digests from its rows; the formatted length from the windows."""
    said = "\\### Assistant: </turn> ok"
    turns = collections.defaultdict(list)
    for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect():
        turns[r.conv_id].append((r.turn is None, r.turn or 0, r.role or "", r.text or ""))
    turns[-7] = [(False, 0, "user", said), (False, 1, "assistant", said)]
    got = {r.conv_id: r for r in chat_format.op7_chat_format(spark, SF).collect()}
    assert set(got) == set(turns)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    for c, rows in turns.items():
        rows.sort()
        learnt = "".join(t for *_, r, t in rows if r == "assistant")
        assert (got[c].n_turns, got[c].turns_sha256) == (len(rows), sha("".join(f"{r}\n{t}\n" for *_, r, t in rows)))
        assert (got[c].loss_chars, got[c].loss_sha256) == (len(learnt), sha(learnt))
        escaped = [t.replace("\\", "\\\\").replace("###", "\\h").replace("</turn>", "\\e") for *_, t in rows]
        assert got[c].formatted_chars >= sum(len(f"### {r}: {t}</turn>\n") for (*_, r, _), t in zip(rows, escaped, strict=True))


# -- 8 personal data


def luhn(digits):
    return sum(sum(divmod(int(d) * (1 + i % 2), 10)) for i, d in enumerate(reversed(digits))) % 10 == 0


def test_pseudonyms_keep_formats_and_links(spark):
    valid = ["4111 1111 1111 1111", "5105105105105100", "+1 (017) 555-7713", "175.102.247.55", "die.55@mail4.example.com", "DE89370400440532013000", "123-45-6789", "2024-02-29", "31.12.2001"]
    invalid = ["4111 1111 1111 1112", "9807915762804490", "999.1.1.1", "DE89370400440532013001", "000-12-3456", "2023-02-29", "13/13/2000", "2.0.1", "plain words"]
    df = spark.createDataFrame([(i, f"a {v} b") for i, v in enumerate(valid + invalid)] + [(100, ", ".join(valid)), (101, None), (102, "")], "doc_id long, text string")
    rows = {r.doc_id: r for r in pii.pseudonymise(df.withColumn("n_replaced", F.lit("clash")), "k").collect()}
    new = [rows[i].text[2:-2] for i in range(len(valid))]
    assert all(a != b and re.sub(r"\d", "9", re.sub("[a-z]", "x", a))[:4] == re.sub(r"\d", "9", re.sub("[a-z]", "x", b))[:4] for a, b in zip(valid[:3], new[:3], strict=True))
    assert luhn(new[0].replace(" ", "")) and luhn(new[1]) and new[5].startswith("DE") and new[4].endswith("@mail4.example.com")
    assert rows[100].text == ", ".join(new) and rows[100].n_replaced == len(valid)
    assert all(rows[len(valid) + i].text == f"a {v} b" and rows[len(valid) + i].n_replaced == 0 for i, v in enumerate(invalid))
    assert rows[101].text is None and rows[102].text == ""
    again = spark.createDataFrame([(i, v) for i, v in enumerate(new)], "doc_id long, text string")
    assert all(r.n_replaced == 1 for r in pii.pseudonymise(again, "k").collect())  # pseudonyms validate
    assert pii.pseudonymise(odd_docs(spark), "k").count() == 11 and pii.pseudonymise(empty(spark), "k").count() == 0


def test_dates_keep_their_format(spark):
    """All dates of a few years in each format: another date of the same widths, order and span, no two alike."""
    days = [datetime.date(y, 1, 1) + datetime.timedelta(n) for y in (1899, 1996, 1999) for n in range(365)]
    forms = {
        "iso": lambda d: f"{d:%Y-%m-%d}", "us": lambda d: f"{d:%m/%d/%Y}", "us_short": lambda d: f"{d.month}/{d.day}/{d.year}",
        "day_first": lambda d: f"{d:%d/%m/%Y}" if d.day > 12 else None, "dotted": lambda d: f"{d.day}.{d.month}.{d.year}", "padded": lambda d: f"{d:%d.%m.%Y}",
    }
    texts = sorted({x for f in forms.values() for d in days if (x := f(d))})
    df = spark.createDataFrame([(x, f"born {x}, really", 1) for x in texts], "value string, text string, hits0 int")
    rows = {r.value: r for r in pii.pseudonymise(df, "k").collect()}
    new = {v: r.text[5:-8] for v, r in rows.items()}
    assert len(set(new.values())) == len(texts) and all(r.hits0 == 1 for r in rows.values())
    shape = lambda x: re.sub("[0-9]", "0", x)
    for old, made in new.items():
        assert shape(old) == shape(made)
        a, b = ([int(n) for n in re.split("[-/.]", x)] for x in (old, made))
        if "/" in old and a[0] > 12:
            assert b[0] > 12
            order = (2, 1, 0)
        else:
            order = (0, 1, 2) if "-" in old else (2, 0, 1) if "/" in old else (2, 1, 0)
        datetime.date(*(b[i] for i in order))
        assert (a[order[0]] - 1900) // 200 == (b[order[0]] - 1900) // 200
    assert sum(old == made for old, made in new.items()) < 10
    odd = spark.createDataFrame([("31/31/1999",), ("2001-02-29",), ("0000-01-01",)], "text string")
    assert all(r.n_replaced == 0 for r in pii.pseudonymise(odd, "k").collect())


def test_feistel_is_a_permutation(spark):
    df = spark.range(7 * 11).select(pii.feistel(F.col("id"), F.lit(7).cast("long"), F.lit(11).cast("long"), "k", "t").alias("v"))
    assert sorted(r.v for r in df.collect()) == list(range(77))


# -- 9 tokens


def test_tokens_equal_the_library(spark):
    tokenizers = pytest.importorskip("tokenizers")
    import public_tokenizers

    library = tokenizers.Tokenizer.from_file(public_tokenizers.path(token_counts.TOKENIZER))
    rnd = random.Random(6)
    texts = ["", "a<|endoftext|>b", "<|endoftext|>" * 2, " " * 30, "aaaa" * 40, "I'll don't", "\x1c\x1d x\u0085", "é😀"] + [
        "".join(chr(rnd.choice([rnd.randrange(32, 127), rnd.randrange(32, 0x2000)])) for _ in range(50)) for _ in range(200)
    ]
    assert token_counts.load(token_counts.TOKENIZER).count(texts) == [len(x) for x in library.encode_batch(texts, add_special_tokens=False)]
    rows = token_counts.count_tokens(odd_docs(spark)).collect()
    assert len(rows) == 11 and all(r.n_tokens == len(library.encode(r.text or "").ids) and r.n_bytes == len((r.text or "").encode()) and r.over_limit == (r.n_tokens > 1024) for r in rows)
    assert token_counts.count_tokens(empty(spark)).count() == 0


# -- 10 fingerprints


def test_sketches_merge_and_estimate():
    rnd = random.Random(8)
    a, b = [f"w{rnd.randrange(3000)}" for _ in range(4000)], [f"w{rnd.randrange(3000)}" for _ in range(4000)]
    b[:2500] = a[:2500]
    grams = lambda w: {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
    x, y = fingerprints.sketches([" ".join(a), " ".join(b)], k=512)
    exact = len(grams(a) & grams(b)) / len(grams(a) | grams(b))
    assert abs(fingerprints.resemblance(x, y, 512) - exact) < 0.08
    assert abs(fingerprints.containment(x, y, 512) - len(grams(a) & grams(b)) / len(grams(a))) < 0.1
    assert abs(fingerprints.distinct(x, 512) / len(grams(a)) - 1) < 0.15
    parts = fingerprints.sketches([" ".join(a[:2004]), " ".join(a[2000:])], k=512)
    assert (fingerprints.merge(*parts, k=512) == x).all() and (fingerprints.decode(fingerprints.encode(x)) == x).all()


def test_fingerprints_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(fingerprints, "BUCKET_ROWS", 7)
    monkeypatch.setattr(fingerprints, "STEP_CHARS", 900)
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()] + [(None, "no id at all"), (-9, None), (10**12, "")]
    got = {r.doc_id: r for r in fingerprints.fingerprint_edits(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    order = sorted(docs, key=lambda d: (d[0] is None, -(d[0] or 0)))
    assert len(got) == len(docs)
    for (i, text), (_, after) in zip(order, [*order[1:], order[0]], strict=True):
        new = fingerprints.edited(text or "", after or "")
        a, e, n = fingerprints.sketches([text, new, after])
        want = (i, len(text or ""), hashlib.sha256(new.encode()).hexdigest(), fingerprints.encode(a), fingerprints.encode(e), fingerprints.resemblance(a, e), fingerprints.resemblance(a, n))
        assert tuple(got[i])[:7] == want
    assert fingerprints.fingerprint_edits(odd_docs(spark)).count() == 11 and fingerprints.fingerprint_edits(empty(spark)).count() == 0
    single = fingerprints.fingerprint_edits(odd_docs(spark).where("doc_id = 1")).collect()
    assert len(single) == 1 and single[0].near_next == 1.0


def test_fingerprints_estimate_what_sets_say(spark):
    """The query against shingle sets of words: exact where the union has at most 128 shingles."""
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = {r.doc_id: r for r in fingerprints.op10_fingerprints(spark, SF).collect()}
    assert set(got) == set(docs)
    order = sorted(docs, reverse=True)

    def grams(text):
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text))
        n = fingerprints.WORDS
        return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())

    errors = []
    for i, following in zip(order, [*order[1:], order[0]], strict=True):
        text, after, r = docs[i], docs[following], got[i]
        cut = len(text) // 3
        new = text[: len(text) - cut] + after[:cut]
        assert r.edited_sha256 == hashlib.sha256(new.encode()).hexdigest() and r.n_chars == len(text)
        own = grams(text)
        assert r.n_shingles == len(own) if len(own) < fingerprints.K else abs(r.n_shingles / len(own) - 1) < 0.4
        for near, held, other in ((r.near_edited, r.held_by_edited, grams(new)), (r.near_next, r.held_by_next, grams(after))):
            union = own | other
            exact = len(own & other) / len(union) if union else 1.0
            share = len(own & other) / len(own) if own else 1.0
            if len(union) <= fingerprints.K:
                assert near == exact
            errors += [abs(near - exact), abs(held - share) / 2]
    assert max(errors) < 0.2 and np.mean(errors) < 0.03
    same = collections.defaultdict(set)
    for i, text in docs.items():
        same[text].add(got[i].fingerprint)
    assert all(len(x) == 1 for x in same.values())


# -- the pipeline


def test_pipeline_equals_its_stages(spark):
    import corpus_pipeline as cp

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    by = {r.doc_id: r for r in docs.collect()}
    model = toxicity.train(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    clean = {i for i, r in by.items() if model.score(r.text)[0] < 0.5}
    kept = {i for i, (_, c) in brute_components([(i, by[i].text) for i in clean], 5, Fraction(8, 10)).items() if c == i}
    rows = cp.run(spark, SF).collect()
    assert all(r.decoded == r.text and len(r.text) == r.n_chars for r in rows)
    assert set(rows[0].asDict()) == {*docs.columns, "piece_ids", "decoded"}
    ids = spark.createDataFrame([(i,) for i in kept], "doc_id long")
    mixed = mixing.mix(docs.join(ids, "doc_id", "left_semi")).collect()
    assert collections.Counter(r.doc_id for r in rows) == {r.doc_id: len(r.positions) for r in mixed if r.positions}
    words = sum(len((by[i].text or "").split()) for i in kept)
    assert abs(sum(len(r.text.split()) for r in rows) - 1.5 * words) < 0.05 * words



def test_mixing_sorts_by_position_and_takes_weights_from_schedules(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = mixing.mix(docs.select("doc_id", "source", mixing.word_count(F.col("text")).alias("words")), size=F.col("words")).collect()
    want = [r.doc_id for r in sorted(rows, key=lambda r: (r.positions[0] if r.positions else 2.0, r.doc_id))]
    assert [r.doc_id for r in mixing.op4_mixing(spark, SF).collect()] == want
    assert mixing.integrals() == (5, 2, 1) and mixing.integrals(((0.25, 0.5), (1.0, 1.0))) == (3, 8)
    sizes = spark.createDataFrame([("a", 1000, 1), ("b", 1000, 1)], "source string, source_size long, n long")
    assert {r.source: r.target for r in mixing.targets(sizes, ((1.0, 1.0), (2.0, 0.0))).collect()} == {"a": 1500.0, "b": 1500.0}
