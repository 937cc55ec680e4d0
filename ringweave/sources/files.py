"""Names of the files that rows come from."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def file_label() -> Column:
    """A file's name, behind that of its folder where the folder has one of the kind key=value."""
    folders = F.regexp_replace(F.array_join(F.regexp_extract_all("_metadata.file_path", F.lit(r"/[^/=]+=([^/]*)"), F.lit(1)), "/"), "%20", " ")
    return F.when(folders != "", folders).otherwise(F.col("_metadata.file_name"))
