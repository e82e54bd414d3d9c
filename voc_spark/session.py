"""Session defaults and the shared folder that outlives any one executor."""

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_local_scratch: dict[str, str] = {}
_shipped: set[str] = set()


PARTITION_BYTES = 256 * 1024 * 1024


def shuffle_partitions(input_bytes: int, least: int = 200) -> int:
    """Enough shuffle partitions for about 256 MB each; adaptive execution merges those that stay small."""
    return max(least, -(-input_bytes // PARTITION_BYTES))


def build_session(
    app: str = "voc_spark", master: str | None = None, input_bytes: int | None = None, **conf: str
) -> SparkSession:
    """A session with AQE, skew-join handling and UTC; `conf` overrides any setting.

    `input_bytes`, the size of the largest table, sets the number of shuffle partitions:
    adaptive execution can merge partitions but not add any for evenly spread data.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        **({"spark.sql.shuffle.partitions": str(shuffle_partitions(input_bytes))} if input_bytes else {}),
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """Folder for written intermediate tables, named by `spark.checkpoint.dir`.

    Only a local session may go without the setting; it then gets one scratch folder.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _local_scratch:
        _local_scratch[app] = tempfile.mkdtemp(prefix="voc-spark-")
    return _local_scratch[app]


def fresh_dir(spark: SparkSession, label: str) -> str:
    """A new, unused path below the shared folder."""
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers, which need it for the model classifier."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    package = Path(__file__).parent
    archive = Path(tempfile.mkdtemp(prefix="voc-spark-")) / "voc_spark.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for source in sorted(package.rglob("*.py")):
            out.write(source, source.relative_to(package.parent))
    spark.sparkContext.addPyFile(str(archive))
    _shipped.add(app)
