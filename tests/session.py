"""The local session of the tests."""

from tillcast.session import build_session


def local_session():
    spark = build_session("tillcast-tests", "local[8]", {
        "spark.sql.shuffle.partitions": "8",
        "spark.ui.enabled": "false",
        "spark.driver.memory": "8g",
        "spark.sql.maxMetadataStringLength": "10000",
        "spark.ui.showConsoleProgress": "false",
    })
    spark.sparkContext.setLogLevel("ERROR")
    return spark
