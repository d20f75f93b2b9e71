"""Operators over small tables with nulls, ties, repeated rows and clashing columns."""

import re
import zlib
from pathlib import Path

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import zstandard
from pyspark.sql import functions as F

import corpus_pipeline
from bicspark.llm import binarycodes, gam, ids, jaccard, mixing, multiprobe, packing, sharding, shingles, skipchain, tokenfile, toxicity
from bicspark.llm.common import ship_code, with_row_key
from bicspark.llm.components import components
from bicspark.llm.queries import QUERIES
from bicspark.plans.stages import Stages, shared_folder

SMALL = "/root/testdata/sf0.001"
BASE = " ".join(f"w{i}" for i in range(60))
TEXTS = [
    (1, BASE, "en", "s1"),
    (2, BASE.upper(), "en", "s2"),
    (3, BASE.replace("w30", "x"), "en", None),
    (4, None, "en", "s1"),
    (5, "", None, "s1"),
    (6, " \n\t ", "en", "s1"),
    (7, "one two", "en", "s3"),
    (8, "One  two", "en", "s3"),
    (8, "One  two", "en", "s3"),
    (None, "no id mail a.b@c.de and +1 (988) 555-2485", "en", "s1"),
    (9, "z " * 20_000, "en", "s1"),
]


@pytest.fixture(scope="module")
def docs(spark):
    ship_code(spark)
    rows = spark.createDataFrame(TEXTS, "doc_id long, text string, lang string, source string")
    # Columns of the names that operators use inside.
    return rows.withColumn("n_chars", F.length("text").cast("bigint")).withColumns(
        {c: F.lit("x") for c in ("size", "unit", "row_", "class", "place", "before", "label", "score", "part_", "ids")}
    )


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(k, k % 2, (k + 1) % 2) for k in range(1, 10)] + [(None, 1, 1)], "doc_id long, quality int, toxic int")


def test_components(spark):
    links = spark.createDataFrame([(k, k + 1) for k in range(1, 9)] + [(20, 12), (5, 5), (None, 3), (20, 30)], "a long, b long")
    found = {r["id"]: r["component"] for r in components(links, Stages(spark)).collect()}
    assert found == {k: 1 for k in range(1, 10)} | {12: 12, 20: 12, 30: 12}


def test_sharding(docs):
    found = sharding.interleave(docs, 8).collect()
    assert len(found) == len(TEXTS)
    for shard in range(8):
        slots = sorted(r["slot"] for r in found if r["shard"] == shard)
        assert slots == list(range(len(slots))) and len(slots) in (1, 2)
    assert {(r["size"], r["text_crc32"]) for r in found if r["doc_id"] == 4} == {(1, 0)}
    assert sharding.interleave(docs.where("false"), 8).count() == 0


def test_mixing(docs):
    found = mixing.mix_documents(docs).collect()
    sizes = {r["doc_id"]: (r["size"], r["taken"]) for r in found}
    assert len(found) == len(TEXTS) and sizes[4] == (0, 0) and sizes[6] == (0, 0)
    assert all(r["taken"] in (0, r["size"], 2 * r["size"]) for r in found)
    sources = {r[0]: r[3] for r in TEXTS}
    assert abs(sum({sources[r["doc_id"]]: r["target"] for r in found}.values()) - 1.5 * sum(r["size"] for r in found)) < 1e-6
    assert mixing.mix_documents(docs.where("false")).count() == 0


def test_overlapping_sources(spark):
    docs = spark.createDataFrame([(k, 10, ["a", "b"] if k % 3 else ["a"]) for k in range(30)] + [(99, 5, [])], "doc_id long, n long, m array<string>")
    targets = spark.createDataFrame([("a", 250.0), ("b", 100.0)], "stratum string, target double")
    found = {r["doc_id"]: r for r in mixing.mix(docs, F.col("n"), F.col("m"), targets).collect()}
    assert sum(r["taken"] for r in found.values()) == 350 and found[99]["taken"] == 0
    assert {r["copies"] for k, r in found.items() if k != 99} == {1, 2}


def test_packing(docs):
    path = public_tokenizers.path("word_bpe_49k.json")
    tokenised = packing.tokenise(docs, path, 1, False)
    pieces = packing.pack(tokenised, 2048).collect()
    by_window: dict = {}
    for r in pieces:
        assert len(r["ids"]) == 4 * r["length"]
        by_window.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for k, parts in by_window.items():
        parts.sort()
        assert [o for o, _ in parts] == np.cumsum([0, *[n for _, n in parts[:-1]]]).tolist()
        assert sum(n for _, n in parts) == 2048 or k == max(by_window)
    long = sorted((r["start"], r["ids"]) for r in pieces if r["doc_id"] == 9)
    whole = next(r["ids"] for r in tokenised.where("doc_id = 9").collect())
    assert b"".join(bytes(i) for _, i in long) == bytes(whole)
    assert packing.pack(tokenised.where("false"), 2048).count() == 0


def test_token_file(spark, docs):
    folder = Stages(spark).path("blocks")
    tokenfile.write_blocks(docs, folder, public_tokenizers.path("byte_bpe_50k.json"), 0, 50_257)
    found = tokenfile.read_documents(spark, folder).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("crc")).collect()
    found.sort(key=lambda r: r["start"])
    assert [r["doc_id"] for r in found] == [None, 1, 2, 3, 4, 5, 6, 7, 8, 8, 9]
    assert [r["start"] for r in found] == np.cumsum([0, *[r["n_tokens"] for r in found[:-1]]]).tolist()
    assert found[4]["n_tokens"] == 1 and found[4]["crc"] == zlib.crc32(bytes(4))


def test_jaccard_join(docs):
    found = [(r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard.join(docs).collect()]
    assert sorted(f for f in found if f[0] and f[0] < 9) == [
        (1, 56, 1), (2, 56, 1), (3, 56, 1), (4, 0, 4), (5, 0, 5), (6, 0, 6), (7, 1, 7), (8, 1, 7), (8, 1, 7)
    ]
    assert (9, 1, 9) in found and any(f[0] is None and f[2] is None for f in found)
    assert jaccard.join(docs.where("false")).count() == 0
    kept = jaccard.representatives(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] or 0 for r in kept.collect()) == [0, 1, 4, 5, 6, 7, 9]


def test_personal_data(docs):
    found = {r["doc_id"]: r for r in skipchain.personal_data(docs).collect()}
    assert found[None]["spans"] == "email:11:19,phone:24:41" and found[None]["n_email"] == 1
    assert found[4]["spans"] == "" and found[4]["n_card"] == 0
    masked = {r["doc_id"]: r for r in skipchain.masked(docs).collect()}
    assert masked[None]["text"] == "no id mail [EMAIL] and [PHONE]" and masked[None]["n_chars"] == 30
    assert masked[4]["text"] is None and masked[1]["text"] == BASE


@pytest.mark.parametrize("scorer", [gam.quality, toxicity.toxicity])
def test_scorers(docs, labels, scorer):
    found = scorer(docs, labels).collect()
    assert len(found) == len(TEXTS) and all(0 <= r["score"] <= 1 for r in found)
    assert all(r["predicted"] == int(r["score"] >= 0.3) for r in found)
    assert not any(r["held_out"] for r in found if r["doc_id"] is None)
    assert scorer(docs, labels.where("false")).count() == len(TEXTS)
    assert scorer(docs.where("false"), labels).count() == 0


def vectors(spark, n=300):
    rng = np.random.default_rng(0)
    rows = [(k, [float(x) for x in rng.standard_normal(16)], "x") for k in range(n)]
    rows += [(n + k, [x + 0.05 * float(e) for x, e in zip(rows[5][1], rng.standard_normal(16))], "x") for k in range(40)]
    odd = [(900, None, "x"), (901, [0.0] * 16, "x"), (902, [float("nan")] * 16, "x"), (903, [1.0, None], "x"), (904, [], "x"), (905, [1.0, 2.0], "x")]
    return spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>, row_ string"), rows


def test_near_duplicate_vectors(spark):
    table, rows = vectors(spark)
    x = np.array([r[1] for r in rows])
    x /= np.linalg.norm(x, axis=1)[:, None]
    like = x @ x.T >= 0.9
    found = {r["vec_id"]: r for r in binarycodes.near_duplicates(table, 0.9).collect()}
    assert len(found) == len(rows) + 6
    assert [found[k]["n_links"] for k in range(len(rows))] == (like.sum(axis=1) - 1).tolist()
    assert found[310]["component_id"] == 5 and not found[310]["kept"]
    assert all(found[k]["n_links"] == 0 and found[k]["component_id"] == k and found[k]["kept"] for k in range(900, 906))
    assert binarycodes.near_duplicates(table.where("false")).count() == 0


def test_nearest_neighbours(spark):
    table, rows = vectors(spark)
    found = multiprobe.search(table, table.where("vec_id % 20 = 0"), 20).collect()
    x = np.array([r[1] for r in rows])
    hits = total = 0
    for q in range(0, len(rows), 20):
        score = x @ x[q]
        score[q] = -np.inf
        best = set(np.argsort(-score)[:20].tolist())
        own = sorted((r["rank"], r["vec_id"], r["score"]) for r in found if r["query_id"] == q)
        assert [r for r, _, _ in own] == list(range(1, len(own) + 1)) and all(abs(score[v] - s) < 1e-9 for _, v, s in own)
        hits, total = hits + len(best & {v for _, v, _ in own}), total + 20
    assert hits / total >= 0.9
    assert not any(r["query_id"] >= 900 for r in found)
    assert multiprobe.search(table.where("false"), table.where("false")).count() == 0


def test_pipeline_stages_are_in_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "personal_data", "mixture", "packing"]
    assert len([q for q in QUERIES if q.startswith("op")]) == 13 and "pipeline" in QUERIES


def test_nearest_of_many_equal_vectors(spark):
    """Ties go to the smaller ids, however many rows are equal; repeated rows count once."""
    rows = [(k, [1.0, 0.5, -0.25]) for k in range(200)] + [(7, [1.0, 0.5, -0.25])] * 3 + [(500, [-1.0, 0.0, 0.0])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = multiprobe.search(table, table.where("vec_id in (3, 100)"), 20).collect()
    for q, ids in ((3, [0, 1, 2, *range(4, 21)]), (100, list(range(20)))):
        assert [r["vec_id"] for r in sorted((r for r in found if r["query_id"] == q), key=lambda r: r["rank"])] == ids


@pytest.mark.parametrize("n_words, changed", [(1200, 14), (1200, 26), (2500, 40)])
def test_two_large_groups_of_copies_are_linked(spark, n_words, changed):
    """Segments in which two versions agree are crowded by their copies, and are needed for the link."""
    rng = np.random.default_rng(changed)
    words = [f"w{k}" for k in rng.integers(0, 10**9, n_words)]
    other = list(words)
    for at in rng.permutation(n_words // 7)[:changed] * 7:
        other[at] = f"x{at}"
    rows = [(2 * k + v, " ".join([*version, f"copy{k}"])) for k in range(30) for v, version in enumerate((words, other))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    plan = jaccard.Plan(75, jaccard.band_limits(n_words))
    plan = jaccard.allocate(jaccard.crowding(docs, plan).collect(), plan)
    tokens = [shingles.sets(pa.array([" ".join(x)]))[0] for x in (words, other)]
    alike = len(np.intersect1d(*tokens)) / len(np.union1d(*tokens))
    assert 0.75 <= alike <= 0.95
    signs = [{int(s) for part in plan.signatures(t, np.array([len(t)])) for s in part[0]} for t in tokens]
    assert signs[0] & signs[1]
    assert {r["component_id"] for r in jaccard.join(docs).collect()} == {0}


def test_one_row_per_group_stays_whatever_the_ids(spark):
    a, b, c, d = (" ".join(f"{x}{k}" for k in range(40)) for x in "abcd")
    rows = [(5, a), (5, b), (1, c), (3, c + " more"), (3, d), (None, d), (None, "z z z"), (None, "z z z"), (7, None), (7, None), (None, ""), (None, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("row_", F.lit("x"))
    found = jaccard.representatives(docs).collect()
    assert sorted((r["doc_id"] or 0, r["text"] or "") for r in found) == [(0, ""), (0, ""), (0, "z z z"), (1, c), (3, d), (5, a), (5, b), (7, "")]
    assert {r["row_"] for r in found} == {"x"}


def test_pipeline_stages_equal_plain_versions(spark, tmp_path, monkeypatch):
    rng = np.random.default_rng(12)
    prose = [" ".join(f"word{k}" for k in rng.integers(0, 5000, 60)) for _ in range(60)]
    rows = [(k, t, "s1" if k % 3 else "s2") for k, t in enumerate(prose)]
    rows += [(100 + k, f"{t} copy", "s1") for k, t in enumerate(prose[:6])]
    rows += [(200 + k, f"{t} write to a{k}.b@c.de or +1 (988) 555-248{k}", "s2") for k, t in enumerate(reversed(prose[-4:]))]
    rows += [(300 + k, f"{k} $$$ !!! " * 20, "s1") for k in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    docs.withColumn("n_chars", F.length("text").cast("bigint")).write.parquet(f"{tmp_path}/documents.parquet")
    labels = spark.createDataFrame([(r[0], int(r[0] < 300)) for r in rows], "doc_id long, quality int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    tables = {}

    def kept(name, stage):
        def run(spark, docs, sf_dir):
            tables[name] = [(r["doc_id"], r["text"], r["source"]) for r in docs.collect()]
            return stage(spark, docs, sf_dir)

        return run

    monkeypatch.setattr(corpus_pipeline, "STAGES", [(n, kept(n, s)) for n, s in corpus_pipeline.STAGES])
    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    good = [r for r in rows if r[0] < 300]
    assert sorted(tables["quality"]) == sorted(rows) and sorted(tables["near_duplicates"]) == good
    sets = {}
    for doc, text, _ in good:
        words = text.lower().split()
        sets[doc] = {tuple(words[i : i + 5]) for i in range(len(words) - 4)}
    first = [r for r in good if not any(4 * len(sets[r[0]] & sets[o[0]]) >= 3 * len(sets[r[0]] | sets[o[0]]) for o in good if o[0] < r[0])]
    assert sorted(tables["personal_data"]) == first and len(first) < len(good)
    masked = [(d, re.sub(r"\+1 \(988\) 555-248\d", "[PHONE]", re.sub(r"\S+@c\.de", "[EMAIL]", t)), s) for d, t, s in first]
    assert sorted(tables["mixture"]) == masked
    mixed = tables["packing"]
    assert set(mixed) <= set(masked) and all(mixed.count(r) <= 2 for r in masked)
    size = {s: sum(len(t.split()) for _, t, x in masked if x == s) for s in ("s1", "s2")}
    share = 1.5 * sum(size.values())
    target = {"s1": min(2 * size["s1"], 5 / 7 * share)}
    target["s2"] = min(2 * size["s2"], share - target["s1"])
    for s in size:
        # A document, of about 60 words, is the smallest step.
        assert abs(sum(len(t.split()) for _, t, x in mixed if x == s) - target[s]) <= 100
    tokenizer = ids.tokenizer(public_tokenizers.path("word_bpe_49k.json"))
    expected = sum(len(tokenizer.encode(t, add_special_tokens=False).ids) + 1 for _, t, _ in mixed)
    assert sum(r["length"] for r in packed) == expected


def test_only_the_last_table_is_left(spark):
    shared = Path(shared_folder(spark))
    before = set(shared.glob("stages-*"))
    packed = corpus_pipeline.run(spark, SMALL)
    assert [p.name for folder in set(shared.glob("stages-*")) - before for p in folder.iterdir()] == ["packing"]
    assert packed.count() > 0


def test_ids_and_columns_stay_as_they_are(spark, labels, tmp_path):
    """Longs next to a null stay the same longs, and columns of the stages' own names stay."""
    ids_ = [2**60 + 1, 2**60 + 3, None, 2**53 + 1, 7]
    texts = ["mail a.b@c.de or +1 (988) 555-2485 please", "some words of prose that stand alone", "x y", None, "A longer text, of one line."]
    named = {"score": 1, "score_": 2, "row": 3, "row_": 4, "copy": 5, "copy_": 6, "copies": 7, "path": 8, "number": 9, "base": 10, "passages": 11}
    docs = spark.createDataFrame(list(zip(ids_, texts)), "doc_id long, text string").withColumns(
        {"source": F.lit("s"), "n_chars": F.length("text").cast("bigint"), **{c: F.when(F.lit(True), F.col("doc_id") + v) for c, v in named.items()}}
    )
    docs.coalesce(1).write.parquet(f"{tmp_path}/docs")
    for rows in (docs.coalesce(1), spark.read.parquet(f"{tmp_path}/docs")):
        for found in (skipchain.personal_data(rows), gam.quality(rows, labels), toxicity.toxicity(rows, labels)):
            assert sorted(r["doc_id"] or 0 for r in found.collect()) == sorted(i or 0 for i in ids_)
        for stage in (gam.kept_by_quality(rows, labels, -1.0), skipchain.masked(rows), jaccard.representatives(rows), mixing.mixture(spark, rows)):
            assert stage.columns == docs.columns
            for r in stage.collect():
                assert r["doc_id"] in ids_ and all(r[c] == (None if r["doc_id"] is None else r["doc_id"] + v) for c, v in named.items())


def test_row_keys_do_not_depend_on_the_split(spark, tmp_path):
    path = f"{tmp_path}/rows"
    spark.range(20_000, numPartitions=3).withColumn("text", F.sha2(F.col("id").cast("string"), 256)).write.parquet(path)
    found = []
    for size in ("128m", "64k"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        found.append(sorted(map(tuple, with_row_key(spark.read.parquet(path), "key", Stages(spark)).select("id", "key").collect())))
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert found[0] == found[1] and len({k for _, k in found[0]}) == 20_000


def test_pieces_of_a_round_are_one(spark):
    """A sequence holds one piece per document and run of rounds, not one per packet."""
    ship_code(spark)
    rows = [(k, "word " * 3000, "a" if k % 2 else "b") for k in range(8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    tokenised = packing.tokenise(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=1, spaces_kept=False)
    pieces = packing.pack(tokenised, 2048).collect()
    assert sum(r["length"] for r in pieces) == sum(r["n_tokens"] for r in tokenised.collect())
    assert len(pieces) <= 8 * 3001 // 1024 * 3
    zipped = packing.tokenise(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=1, spaces_kept=False, zipped=True)
    assert sorted(map(tuple, packing.pack(zipped, 2048).collect())) == sorted(map(tuple, pieces))
    shares = {}
    for r in pieces:
        shares.setdefault(r["sequence_id"], {}).setdefault(r["stratum"], []).append(r["length"])
    for sequence, found in shares.items():
        if sequence < max(shares):
            assert all(abs(sum(v) - 1024) <= packing.PACKET for v in found.values())


def test_zipped_ids_take_two_bytes_where_they_fit(spark):
    ship_code(spark)
    rows = [(1, "word one two " * 50, "a"), (2, None, "a"), (3, "", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    path = public_tokenizers.path("word_bpe_49k.json")
    plain = {r["doc_id"]: r for r in packing.tokenise(docs, path, 1, False).collect()}
    for r in packing.tokenise(docs, path, 1, False, zipped=True).collect():
        unzipped = zstandard.ZstdDecompressor().decompress(r["zipped"])
        assert len(unzipped) == 2 * r["n_tokens"] == 2 * plain[r["doc_id"]]["n_tokens"]
        assert np.array_equal(np.frombuffer(unzipped, "<u2"), np.frombuffer(plain[r["doc_id"]]["ids"], "<u4"))
    # Ids that need more stay whole, beside documents whose ids do not.
    numbers = {1: np.arange(70_000, 73_000), 2: np.arange(5), 3: np.array([0, 65_535]), 4: np.array([65_536])}
    zip_ = zstandard.ZstdCompressor().compress
    rows = [(k, "s", len(v), bytearray(zip_(packing._narrow(v).tobytes()))) for k, v in numbers.items()]
    zipped = spark.createDataFrame(rows, "doc_id long, stratum string, n_tokens long, zipped binary")
    found = {}
    for r in sorted(packing.pack(zipped, 2048).collect(), key=lambda r: (r["doc_id"], r["start"])):
        found.setdefault(r["doc_id"], []).append(np.frombuffer(r["ids"], "<u4"))
    assert {k: np.concatenate(v).tolist() for k, v in found.items()} == {k: v.tolist() for k, v in numbers.items()}


def test_only_texts_of_holders_are_hashed_again(spark):
    ship_code(spark)
    words = " ".join(f"w{k}" for k in range(40))
    rows = [(1, words), (1, "other " + words), (2, words), (None, "third " + words), (None, None), (3, "last of all these words")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    # The key is that of the class: its lower 48 bits.
    key = F.col("class").bitwiseAND(F.lit((1 << 48) - 1)).alias("key")
    described = jaccard.describe(docs).where(F.col("class").isNotNull())
    classes = described.groupBy(key, "class").agg(F.xxhash64(F.min("doc_id")).alias("holder"))
    wanted = classes.select("key")
    found = {r["class"] for r in jaccard.wanted_sets(docs, classes, wanted, 4).collect()}
    assert found == {r["class"] for r in classes.collect()} and len(found) == 4
    # No document has the id that the holder names, so none is read.
    elsewhere = classes.withColumn("holder", F.xxhash64(F.lit(10**9).cast("bigint")))
    assert jaccard.wanted_sets(docs, elsewhere, wanted, 4).count() == 0
    found = {(r["doc_id"], r["component_id"]) for r in jaccard.join(docs).collect()}
    assert found == {(1, 1), (2, 1), (None, 1), (None, None), (3, 3)}
