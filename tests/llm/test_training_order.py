"""No source vanishes from the training order."""

from brindle.llm import mixing


def test_less_than_half_of_the_only_document(spark):
    # a weighs 1 of 6 of 1,900 words: 316 of the 1,000 words of its document
    rows = [(0, "w " * 1000, "a")] + [(i, "w " * 10, "b" if i <= 45 else "c") for i in range(1, 91)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    only = [r for r in mixing.mix(docs).collect() if r["id"] == 0][0]
    assert sum(2 * p["taken"] >= only["size"] for p in only["passes"]) == 0
    assert mixing.training_order(docs).where("doc_id = 0").count() == 1


DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def test_rows_without_an_id_and_repeated_ids_are_read_as_often_as_the_mix_takes_them(spark):
    rows = [(None, f"null {i} " * 5, None, "a", i) for i in range(50)] + [(7, f"same id {i} " * 5, None, "b", i) for i in range(20)] + [(9, "whole copy " * 5, "x", "c", 3)] * 6 + [(None, None, None, None, None), (3, "", None, "a", 0)]
    docs = spark.createDataFrame(rows, DOCS)
    found = mixing.mix(docs).collect()
    want = sum(1 for r in found for p in r["passes"] if 2 * p["taken"] >= r["size"])
    got = mixing.training_order(docs).collect()
    assert len(got) == want and max(sum(r["doc_id"] is None and r["n_chars"] == k for r in got) for k in range(50)) <= 3
    assert sum(r["source"] == "c" for r in got) == sum(1 for r in found if r["source"] == "c" for p in r["passes"] if 2 * p["taken"] >= r["size"])


def test_the_order_is_read_from_the_files(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"w{i} " * (1 + i % 9), None, "abc"[i % 3], i) for i in range(400)], DOCS).repartition(6)
    placed = {(r["id"], p["pass"]): p["position"] for r in mixing.mix(docs).collect() for p in r["passes"]}
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # so that several files are written
    try:
        mixing.training_order(docs).write.parquet(f"{tmp_path}/mixed")
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    back = spark.read.parquet(f"{tmp_path}/mixed")
    rows = sorted((r["at"], r["doc_id"]) for r in mixing.placed(back, "at").collect())
    assert len({a >> 40 for a, _ in rows}) > 1 and len({a for a, _ in rows}) == len(rows)
    seen, now = {}, []
    for _, d in rows:
        seen[d] = seen.get(d, -1) + 1
        now.append(min(v for (i, k), v in placed.items() if i == d and k == seen[d]))
    assert now == sorted(now)
