"""Driver contract."""

import __spark_entry__ as E


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.columns == ["doc_id", "term", "tf", "weight"]
    assert df.count() > 0


def test_oracle_keys_are_queries():
    assert set(E.oracle_sql()) <= set(E.queries())
    assert len(E.queries()) >= 38


def test_cluster_without_shared_folder_raises():
    import pytest

    from revspark.session import checkpoint_dir

    class Conf:
        def __init__(self, **kw):
            self.kw = kw

        def get(self, key, default=None):
            return self.kw.get(key.replace(".", "_"), default)

    class Session:
        conf = Conf()

        class sparkContext:
            @staticmethod
            def getConf():
                return Conf(spark_master="spark://host:7077")

    with pytest.raises(ValueError):
        checkpoint_dir(Session)
