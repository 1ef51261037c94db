import pathlib

from pyspark.sql import SparkSession

from passagework import session


def test_tables_are_written_once_and_released(tmp_path, monkeypatch, spark: SparkSession):
    monkeypatch.setattr(session, "shared_folder", lambda _: str(tmp_path))
    monkeypatch.setattr(session, "_WRITTEN", [])
    before = spark.conf.get(session.FREE_SHUFFLES, "false")
    kept = session.materialise(spark.range(10).selectExpr("id", "id % 2 AS part"), ("part",))
    assert kept.count() == 10 and len(list(pathlib.Path(tmp_path).glob("table-*/part=*"))) == 2
    assert spark.conf.get(session.FREE_SHUFFLES, "false") == before
    assert session.release_tables(spark) == 1 and not list(tmp_path.iterdir())
    assert session.release_tables(spark) == 0
