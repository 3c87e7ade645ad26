import pytest


@pytest.fixture(scope="session", autouse=True)
def shared_folder(spark, tmp_path_factory):
    """Intermediate tables of the tests go to one temporary shared folder."""
    if not spark.conf.get("spark.checkpoint.dir", None):
        spark.sparkContext.setCheckpointDir("file://" + str(tmp_path_factory.mktemp("shared")))
