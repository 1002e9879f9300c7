import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from rotativa.session import local_session  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = local_session(4, "tests", **{
        "spark.sql.shuffle.partitions": "4", "spark.driver.memory": "8g",
        "spark.checkpoint.dir": str(tmp_path_factory.mktemp("shared")),
    })
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


# Hand-made texts that are hard in one way or another.
TEXTS = [
    None, "", "   ", " \n\t", "hola", "!!!! ???? ....", "a\r\r\r\rb", "x​y﻿z w", "ñandu@a.com", "HTTP://X.y/z).",
    "www.a.b, y más", "Escribe a user@host.tld. Ya", "ver http://a.b/?m=x@y.zz fin", "“Cita” 'otra' \"más\"", "10² m",
    "Ⅰ y Ⅱ", "😀", "👍🏽 bien 🇪🇸", "increíííble!!!", "50% de 3,5%", "se podría según que impactante", "İstanbul ES İ",
    "a_b _ c", "uno. dos! ¿tres? ... ! —", "línea\nuna\n\n\nlínea", "ℹ info ©", "a  b c d", "ΑΣ ΣΑΣ",
]


@pytest.fixture(scope="session")
def texts(spark):
    rows = [(i, t) for i, t in enumerate(TEXTS)]
    return spark.createDataFrame(rows, "Id long, Text string").repartition(4)


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").selectExpr("doc_id AS Id", "text AS Text")
