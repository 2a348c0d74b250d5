import pytest

from tessella.session import get_spark


@pytest.fixture(scope="session")
def spark():
    return get_spark("tessella-tests", cores=4, partitions=4)


@pytest.fixture
def shuffled(spark):
    """A function that gives the MB that were shuffled since the one before; tasks of this process only."""
    context = spark.sparkContext._jsc.sc()
    seen = [0]

    def mb() -> float:
        context.listenerBus().waitUntilEmpty()
        now = context.statusStore().executorList(False).apply(0).totalShuffleWrite()
        seen[0], before = now, seen[0]
        return (now - before) / 1e6

    mb()
    return mb
