"""Tables between stages: written once, dropped, cleared."""

from pathlib import Path

from tessella.sources import scratch


def there(df):
    return Path(df._staged.removeprefix("file://")).exists()


def test_stages_are_dropped_and_cleared(spark):
    a, b = scratch.stage(spark.range(3), "a"), scratch.stage(spark.range(4), "b")
    assert there(a) and there(b) and a.count() == 3
    scratch.drop(a)
    assert not there(a) and there(b)
    scratch.clear(spark)
    assert not there(b) and scratch.stage(spark.range(2), "c").count() == 2
    folder = Path(scratch.mounted_folder(spark, "x"))
    folder.mkdir(parents=True)
    (folder / "f").write_text("x")
    scratch.drop_folder(spark, str(folder))
    assert not folder.exists()
