"""Sending a store to object storage."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

from corvella.errors import StoreError
from corvella.functions.text import remote_key
from corvella.sources.files import file_digests
from corvella.sources.store import Store
from pyspark.sql import functions as F

#: Of each backend the scheme Hadoop knows it by, and the settings its credentials go to, with the variables they come from.
BACKENDS = {
    "s3": ("s3a", {"fs.s3a.access.key": "AWS_ACCESS_KEY_ID", "fs.s3a.secret.key": "AWS_SECRET_ACCESS_KEY", "fs.s3a.endpoint": "AWS_ENDPOINT_URL"}),
    "gcs": ("gs", {"google.cloud.auth.service.account.json.keyfile": "GOOGLE_APPLICATION_CREDENTIALS"}),
    "azure": ("abfss", {"fs.azure.account.key": "AZURE_STORAGE_KEY"}),
    "file": ("file", {}),
}


def backend(name: str) -> tuple[str, dict[str, str]]:
    if name not in BACKENDS:
        raise ValueError(f"no backend {name!r}; there are {', '.join(BACKENDS)}")
    return BACKENDS[name]


def credentials(name: str, given: dict[str, str] | None = None, environ: dict[str, str] | None = None) -> dict[str, str]:
    """Hadoop settings of a backend: those given, by the setting's name, else those of the environment."""
    environ = os.environ if environ is None else environ
    found = {k: (given or {}).get(k, environ.get(v)) for k, v in backend(name)[1].items()}
    return {k: v for k, v in found.items() if v}


def upload(store: Store, backend_name: str, bucket: str, prefix: str = "", given: dict[str, str] | None = None, plain: bool = False) -> DataFrame:
    """Copies the newest version of the store and gives ``(path, sha256)`` of the files sent, which also stand in ``checksums`` there.

    Data that are not encrypted are refused unless ``plain``.
    """
    store.access.require("backup")
    scheme = backend(backend_name)[0]
    if not store.is_encrypted and not plain:
        raise StoreError("the store is not encrypted")
    spark: SparkSession = store.spark
    conf = spark._jsc.hadoopConfiguration()
    for k, v in credentials(backend_name, given).items():
        conf.set(k, v)
    key = spark.range(1).select(remote_key(prefix, F.lit(store.path.rsplit("/", 1)[-1]))).first()[0]
    target = f"{scheme}://{bucket}/{key}"
    store._copied(target)
    sums = file_digests(spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(target).select("path", "content"))
    sums.write.mode("overwrite").json(f"{target}/checksums")
    return spark.read.schema("path string, sha256 string").json(f"{target}/checksums")
