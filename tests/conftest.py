import datetime as dt
import os
import sys

import pytest

HERE = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, os.path.dirname(HERE))
# stubs defined in the tests have to be found by the Python workers
os.environ["PYTHONPATH"] = os.pathsep.join([os.path.dirname(HERE), HERE, os.environ.get("PYTHONPATH", "")])

from parley.session import get_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = get_session(
        "tests",
        "local[4]",
        **{
            "spark.sql.shuffle.partitions": "4",
            "spark.ui.enabled": "false",
            "spark.driver.memory": "6g",
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


def ts(text: str) -> dt.datetime:
    return dt.datetime.fromisoformat(text)


ANDROID = """03/02/2023, 19:40 - Odile: Qui apporte le gâteau samedi ?
03/02/2023, 19:42 - Bruno: Une tarte, du café
03/02/2023, 19:45 - Odile: <Media omitted>
03/02/2023, 19:46 - Messages and calls are end-to-end encrypted
04/02/2023, 07:05 - Katell: Le train part vers midi
04/02/2023, 07:06 - Katell: rentrée prévue lundi
"""

IOS = """[05/03/2023 à 21:10:00] Odile : La clé est sous le pot
[05/03/2023 à 21:12:30] Bruno : Merci, bonne soirée
[06/03/2023, 06:55:00] Katell : Réunion reportée jeudi
"""
