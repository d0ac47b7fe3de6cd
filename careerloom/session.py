"""Session helpers."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()
#: Bytes of an Arrow batch: what a Python worker, and the JVM beside its heap, hold of a task's rows at once.
BATCH_BYTES = 4 << 20


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors, once for each application, and bounds Arrow batches by bytes.

    Python workers import functions by name; on a cluster they have no copy of the repository.
    """
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    _shipped.add(app)
    root = Path(__file__).parent
    out = Path(tempfile.mkdtemp(prefix="careerloom-")) / "careerloom_pkg.zip"
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, f"{root.name}/{p.relative_to(root)}")
    spark.sparkContext.addPyFile(str(out))
