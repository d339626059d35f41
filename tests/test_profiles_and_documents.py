import json
import random

import pytest
from pyspark.sql import functions as F

from lodeweave.operators import dedupe, minhash, profiles
from lodeweave.sources import documents

KIND = "id long, s struct<a:int,b:struct<c:string,d:array<double>>>, m map<string,array<struct<x:int>>>, j string, n string"


def rows():
    return [
        (1, (1, ("x", [1.0, 2.5])), {"k": [(1,), (2,)], "l": []}, '{"a": 1, "b": {"c": [true, "t", null]}, "d": 1.5}', ""),
        (2, (None, ("", None)), None, '{"a": "one", "b": {}}', "text"),
        (3, None, {"k": None}, "broken {", None),
        (4, (4, None), {"z": [(None,)]}, None, "other"),
        (5, (5, ("y", [])), {}, '[1, [2, 3], {"q": 1}]', "text"),
    ]


def test_paths_of_nested_data(spark):
    df = spark.createDataFrame(rows(), KIND)
    got = {r.field_name: r for r in profiles.described(profiles.nested_profile(df, ["j"])).collect()}
    brief = {p: (round(r.presence_rate * 5), r.n_values, r.data_type) for p, r in got.items()}
    assert brief == {
        "id": (5, 5, "bigint"), "s.a": (3, 3, "int"), "s.b.c": (2, 2, "string"), "s.b.d[]": (1, 2, "double"), "m.k[].x": (1, 2, "int"), "n": (3, 3, "string"),
        "j.a": (2, 2, "bigint|string"), "j.b.c[]": (1, 2, "boolean|string"), "j.d": (1, 1, "decimal(2,1)"), "j[]": (1, 1, "bigint"), "j[][]": (1, 2, "bigint"), "j[].q": (1, 1, "bigint"),
    }
    assert got["s.a"].minimum == 1 and got["s.a"].maximum == 5 and got["s.a"].median == 4 and got["n"].median is None and got["n"].avg_length == 13 / 3
    assert got["j.a"].minimum == 1 and got["j[][]"].maximum == 3
    shallow = {r.path for r in profiles.nested_profile(df, ["j"], depth=1).collect()}
    assert "j.b" in shallow and "j.b.c[]" not in shallow
    assert profiles.nested_profile(df.limit(0), ["j"]).count() == 0


def test_merged_profiles_equal_one_of_all(spark):
    df = spark.createDataFrame(rows(), KIND)
    whole = sorted(tuple(r) for r in profiles.described(profiles.nested_profile(df, ["j"])).fillna(-1).collect())
    parts = [profiles.nested_profile(df.where(c), ["j"]) for c in ("id <= 2", "id = 3", "id > 3")]
    assert sorted(tuple(r) for r in profiles.described(profiles.merged(*parts)).fillna(-1).collect()) == whole


def test_sketches_keep_their_bounds(spark):
    df = spark.range(60_000).select((F.col("id") % 20_011).alias("v"), F.col("id").alias("w"))
    parts = [profiles.nested_profile(df.where(F.col("w") % 3 == k)) for k in range(3)]
    got = {r.field_name: r for r in profiles.described(profiles.merged(*parts)).collect()}
    assert abs(got["v"].approx_distinct - 20_011) < 0.04 * 20_011 and abs(got["w"].approx_distinct - 60_000) < 0.04 * 60_000
    assert abs(got["w"].median - 30_000) < 0.03 * 60_000 and got["w"].n_values == 60_000


def test_bands_find_near_pairs_with_fewer_candidates(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(3))
    common = [word() for _ in range(40)]
    texts = []
    for _ in range(60):
        base = [word() for _ in range(rng.choice([30, 80]))] + common
        for _ in range(5):
            w = list(base)
            for _ in range(rng.choice([0, 1, 2, 4])):
                w[rng.randrange(len(w))] = word()
            texts.append(" ".join(w))
    docs = spark.createDataFrame(list(enumerate([*texts, "", None, "two words"])), "id long, content string")
    truth = dedupe.near_pairs(docs)
    got = minhash.recall(minhash.near_pairs(docs), truth).first()
    assert got.pairs > 200 and got.wrong == 0 and got.recall >= 0.9
    pairs, _ = minhash.candidates(docs)
    sets = dedupe._Sets(docs.na.fill(""), 0.85, 3, 5000)
    by_prefix = sets.whole.join(sets.cut, "g").where("j < i").select("i", "j").distinct().count()
    assert pairs.count() < by_prefix


def test_documents_are_whole_or_not_there(spark, tmp_path):
    df = spark.range(500).select("id", F.concat(F.lit('é"\n'), F.col("id").cast("string")).alias("t")).repartition(5)
    want, schema, path = sorted((r.id, r.t) for r in df.collect()), "id bigint, t string", f"file://{tmp_path}/out"
    read = lambda: sorted((r.id, r.t) for r in documents.read_document(spark, path, schema).collect())
    documents.write_document(df, path)
    assert read() == want and documents.manifest(path)["rows"] == 500
    whole = json.loads((tmp_path / "out" / documents.manifest(path)["document"]).read_text())
    assert sorted((r["id"], r["t"]) for r in whole) == want
    documents.write_document(df.limit(7), path, "array", {"total": 7, "name": "report"})
    report = json.loads((tmp_path / "out" / documents.manifest(path)["document"]).read_text())
    assert report["total"] == 7 and len(report["rows"]) == 7 and len(read()) == 7
    documents.write_document(df, path, "parts")
    assert read() == want and sum(p["rows"] for p in documents.manifest(path)["parts"]) == 500
    broken = df.withColumn("t", F.when(F.col("id") == 321, F.raise_error(F.lit("no"))).otherwise(F.col("t")))
    with pytest.raises(Exception, match="no"):
        documents.write_document(broken, path, "parts")
    assert read() == want and not list((tmp_path / "out").glob("_staging*"))
    with pytest.raises(Exception, match="FileExistsError"):
        documents.write_document(df.limit(3), path, overwrite=False)
    assert read() == want and not list((tmp_path / "out").glob("_staging*"))
    documents.write_document(df.limit(0), path, "array")
    assert read() == [] and json.loads((tmp_path / "out" / documents.manifest(path)["document"]).read_text()) == []
