"""M5 stacked fusion: no row is scored by a head that learned from it, test rows are never read, both levels help."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from medfuse.operators import rounds as RD
from medfuse.operators import stacking as ST

COLUMNS = {"one": ["a", "b"], "two": ["c"]}
FIRST, SECOND = RD.RoundSettings(rounds=25, step=0.1), RD.RoundSettings(rounds=40, step=0.1)


def frame(spark, n=240):
    rng = np.random.default_rng(7)
    rows = []
    for i in range(n):
        a, b, c = (float(v) for v in rng.normal(size=3))
        rows.append((i, a, b if i % 9 else None, c, int(a + 2 * c > 0), float(4 + a - c),
                     "test" if i % 4 == 0 else "validation" if i % 4 == 1 else "train"))
    return spark.createDataFrame(rows, "Patient_ID long, a double, b double, c double, CVD_Presence int, Time_To_Event double, split string")


def values(model):
    names = ST.value_columns(list(COLUMNS))
    return {r["Patient_ID"]: (r["split"], r["fold"], tuple(r[c] for c in names)) for r in model.out_of_fold.collect()}


def test_own_labels_never_reach_out_of_fold_values(spark):
    df = frame(spark)
    model = ST.fit_stacked(df, COLUMNS, FIRST, SECOND)
    said = values(model)
    assert set(said) == {i for i in range(240) if i % 4} and {f for _, f, _ in said.values()} == {0, 1, 2}
    # other labels in fold 1 and in the test rows: the values of fold 1 stay, those of the other training folds change
    mine = (F.col("split") == "test") | ((F.col("split") == "train") & (ST.fold_of() == 1))
    turned = df.withColumn("CVD_Presence", F.when(mine, 1 - F.col("CVD_Presence")).otherwise(F.col("CVD_Presence"))) \
               .withColumn("Time_To_Event", F.when(mine, -F.col("Time_To_Event")).otherwise(F.col("Time_To_Event")))
    other = values(ST.fit_stacked(turned, COLUMNS, FIRST, SECOND))
    for i, (split, fold, v) in said.items():
        if split == "train":
            assert (v == pytest.approx(other[i][2], abs=1e-9)) == (fold == 1)
    scored = ST.predict_stacked(model, df.where("split = 'test'")).collect()
    assert len(scored) == 60 and np.mean([r["pred_class"] == r["CVD_Presence"] for r in scored]) > 0.85
    one = RD.predict_rounds(model.heads["one"], df.where("split = 'test'")).collect()
    assert np.mean([r["pred_class"] == r["CVD_Presence"] for r in scored]) > np.mean([r["pred_class"] == r["CVD_Presence"] for r in one])


def test_folds_of_null_keys_and_too_few_folds(spark):
    assert spark.createDataFrame([(None,)], "Patient_ID long").select(ST.fold_of()).first()[0] == -1
    with pytest.raises(ValueError):
        ST.fit_stacked(frame(spark, 8), COLUMNS, folds=1)
