"""What a session needs before its tasks can run this package."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()
#: Rows of an Arrow batch. Rows hold whole texts, so the default of 10,000 would make batches of many MB.
ARROW_ROWS = 2000


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors, once for each application, and bounds its Arrow batches."""
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = Path(__file__).resolve().parent
    target = f"{tempfile.mkdtemp(prefix='depscope-')}/depscope.zip"
    with zipfile.ZipFile(target, "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent).as_posix())
    spark.sparkContext.addPyFile(target)
    _shipped.add(app)
