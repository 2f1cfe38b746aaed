"""Principal axes by passes over blocks against a dense decomposition."""

import numpy as np
import pytest

from codeloom.operators import index, projection


@pytest.mark.parametrize(("n", "d"), [(200, 3), (300, 40), (40, 120), (2, 5)])
def test_axes(spark, n, d):
    rng = np.random.default_rng(n)
    x = rng.normal(size=(n, d)) * np.linspace(3, 0.2, d) + 5.0
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "row_id bigint, embedding array<double>").repartition(3)
    mean, axes = projection.principal_axes(df, block=4)
    assert mean == pytest.approx(x.mean(axis=0))
    _, sizes, wanted = np.linalg.svd(x - x.mean(axis=0), full_matrices=False)
    for i in range(2 if n > 2 else 1):
        assert abs(axes[:, i] @ wanted[i]) == pytest.approx(1.0, abs=1e-6)
        assert axes[np.abs(axes[:, i]).argmax(), i] > 0
    table = projection.project_pca(df).orderBy("row_id").collect()
    assert [r.x for r in table] == pytest.approx(((x - mean) @ axes[:, 0]).tolist())


def test_equal_vectors_and_too_few(spark):
    same = spark.createDataFrame([(i, [1.0, 2.0, 3.0]) for i in range(4)], "row_id bigint, embedding array<double>")
    assert all(abs(r.x) < 1e-9 and abs(r.y) < 1e-9 for r in projection.project_pca(same).collect())
    with pytest.raises(ValueError, match="two vectors"):
        projection.project_pca(same.limit(1))


def test_targets_of_an_index(spark, small_codebook):
    rng = np.random.default_rng(1)
    rows = [(i, f"t{i}", c, "", p, "", rng.normal(size=4).tolist()) for i in range(12) for c, p in ((("A1", "A"), ("B1", "B")) if i % 3 == 0 else (("A2", "A"),))]
    long = spark.createDataFrame(rows, "row_id bigint, text string, code string, code_name string, parent_code string, parent_name string, embedding array<double>")
    built = index.build_index(long, small_codebook)
    sizes = {(t, s): projection.project_index(built, t, s).count() for t in ("examples", "parents") for s in (False, True) if not (t == "parents" and s)}
    assert sizes == {("examples", False): 16, ("examples", True): 8, ("parents", False): 2}
    codes = projection.project_index(built, "codes").collect()
    assert sorted(r.code for r in codes) == ["A1", "A2", "B1"] and {r.point_type for r in codes} == {"subcategory_centroid"} and codes[0].__fields__[:2] == ["x", "y"]
    assert projection.project_index(built, "examples", sample_size=5).count() == 5
    with pytest.raises(ValueError, match="target"):
        projection.project_index(built, "all")
