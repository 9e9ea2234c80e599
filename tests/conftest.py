import pytest

from lodestrata.session import session


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    base = tmp_path_factory.mktemp("spark")
    s = session(
        "tests", "local[4]", spark__sql__shuffle__partitions="4", spark__ui__enabled="false", spark__ui__showConsoleProgress="false",
        spark__sql__warehouse__dir=str(base / "warehouse"), spark__checkpoint__dir=f"file://{base}/checkpoints", spark__driver__memory="3g",
    )
    s.sparkContext.setLogLevel("ERROR")
    return s
