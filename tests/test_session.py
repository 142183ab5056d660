import os

from tidegrid.plans import session


def test_written_tables_can_be_dropped(spark):
    session.drop_written(spark)
    folder = session.shared_folder(spark).removeprefix("file://").removeprefix("file:")
    before = set(os.listdir(folder))
    df = session.written(spark.range(5))
    assert df.count() == 5 and len(set(os.listdir(folder)) - before) == 1
    assert session.drop_written(spark) == 1 and set(os.listdir(folder)) == before
