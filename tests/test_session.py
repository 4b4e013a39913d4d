from cartwright import session


class Conf:
    def __init__(self, **settings):
        self.settings = settings

    def get(self, key, default=None):
        return self.settings.get(key, default)


class Fake:
    def __init__(self, **settings):
        self.conf = Conf(**{"spark.app.id": "app-1", **settings})


def test_scratch_is_below_the_checkpoint_folder():
    fake = Fake(**{"spark.checkpoint.dir": "hdfs://shared/checkpoints/", "spark.sql.warehouse.dir": "/w"})
    assert session.scratch_dir(fake, "a", "b") == "hdfs://shared/checkpoints/cartwright/app-1/a/b"


def test_without_one_it_is_below_the_warehouse():
    fake = Fake(**{"spark.sql.warehouse.dir": "s3a://lake/warehouse"})
    assert session.scratch_dir(fake, "a") == "s3a://lake/warehouse/cartwright/app-1/a"


def test_queries_leave_the_session_as_it_is(spark):
    from cartwright.queries import QUERIES

    keys = ("spark.sql.shuffle.partitions", "spark.sql.files.maxPartitionBytes")
    before = [spark.conf.get(k) for k in keys]
    QUERIES["filtered_revenue"].run(spark, "/root/testdata/sf0.001").collect()
    assert [spark.conf.get(k) for k in keys] == before
