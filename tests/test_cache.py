"""Embedding caches in their three layouts, and settings that do not match."""

import pytest

from haplospark.sources.cache import layout_of, read_cache, with_embeddings, write_cache


def test_layouts_and_settings(spark, tmp_path):
    settings = {"half_window": 500, "buffer": 0, "mode": "disjoint", "backend": "b"}
    tables = {
        "fingerprint": spark.createDataFrame([(7, [1.0, 2.0]), (8, [3.0, 4.0])], "fp_id long, embedding array<double>"),
        "window": spark.createDataFrame([(1, [1.0]), (2, [2.0])], "window_id long, embedding array<double>"),
        "sample": spark.createDataFrame([("a", 1, [1.0]), ("b", 1, [2.0]), ("a", 2, [3.0])], "sample string, window_id long, embedding array<double>"),
    }
    windows = spark.createDataFrame([("a", 1, 7), ("b", 1, 8), ("a", 2, 7)], "sample string, window_id long, fp_id long")
    want = {"fingerprint": [[1.0, 2.0], [1.0, 2.0], [3.0, 4.0]], "window": [[1.0], [2.0], [1.0]], "sample": [[1.0], [3.0], [2.0]]}
    for name, table in tables.items():
        assert layout_of(table.columns) == name
        write_cache(table, f"{tmp_path}/{name}", **settings)
        vectors = read_cache(spark, f"{tmp_path}/{name}", **settings)
        got = with_embeddings(windows, vectors).orderBy("sample", "window_id").collect()
        assert [r.embedding for r in got] == want[name] and len(got) == 3
        assert read_cache(spark, f"{tmp_path}/{name}", mode="disjoint").count() == table.count()
        with pytest.raises(ValueError, match="buffer is 0, not 5, half_window is 500, not 1000"):
            read_cache(spark, f"{tmp_path}/{name}", half_window=1000, buffer=5, mode="disjoint")
        with pytest.raises(ValueError, match="absent"):
            read_cache(spark, f"{tmp_path}/{name}", pooling="mean")
    with pytest.raises(ValueError, match="without a vector"):
        with_embeddings(spark.createDataFrame([(9,)], "window_id long"), tables["window"])
    assert with_embeddings(spark.createDataFrame([(9,), (2,)], "window_id long"), tables["window"], require_all=False).count() == 1
    with pytest.raises(ValueError, match="lack"):
        with_embeddings(windows.drop("fp_id"), tables["fingerprint"])
    with pytest.raises(ValueError):
        layout_of(["window_id", "vector"])
