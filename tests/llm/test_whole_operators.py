"""Training-data operators on inputs where a part of the job could be left out."""

import pytest
from pyspark.sql import functions as F

from latticeworks.llm import decontaminate, ngramlm


def test_lm_filter_is_not_capped(spark, monkeypatch):
    """Scores are the same however many slices the filter of pairs comes in."""
    rows = [(i, " ".join(f"w{(i * 7 + j * j) % 211}" for j in range(60))) for i in range(80)] + [(None, "w1 w2"), (99, None), (99, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(ngramlm, "PART", 256)
    made = []
    for most in (1 << 31, 4096):
        monkeypatch.setattr(ngramlm, "MOST_BITS", most)
        got = ngramlm.score_documents(df.withColumn("held_out", F.lit(False)), df.where("doc_id % 2 = 0")).collect()
        made.append({(r.doc_id, r.n_tokens): (r.n_known, r.base_score, r.score) for r in got})
    assert made[0].keys() == made[1].keys() and len(made[0]) == 82
    for k, want in made[0].items():
        assert made[1][k] == pytest.approx(want, abs=1e-9)


def test_copies_bind_their_own_values(spark):
    """An exact copy and a changed one in one document, and an item of names and numbers alone."""
    q = "take 3 red cubes and 5 blue balls from box"
    other = q.replace("3", "4").replace("5", "2")
    named = "Anna Berta Clara Dora Emma Frieda Gerda Hanna 17 19 23 29"
    rows = [(1, f"{q} . {other}"), (2, f"so {named} it is"), (3, "so " + named.replace("Dora", "Paula").replace("23", "24") + " it is")]
    items = spark.createDataFrame([(1, q), (2, named)], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.matched for r in decontaminate.contaminated(spark.createDataFrame(rows, "doc_id long, text string"), items).collect()}
    assert got == {(1, 1): 3, (2, 2): 5}
