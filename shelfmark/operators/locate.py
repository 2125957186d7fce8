"""URIs: where descriptors, repositories and resources are found; slugs and formats."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import extension, list_block, metadata_uri, parent_uri, slug
from .joins import flagged, known, row_key, salted_lookup

# Hosts whose raw files can be fetched, and from where.
RAW_HOSTS = {"github.com": "https://raw.githubusercontent.com"}

# scheme://[user@]host[:port]/path, and the short form user@host:path
_LONG = r"^([A-Za-z][A-Za-z0-9+.-]*)://(?:([^@/]*)@)?([^/:?#]+)(?::(\d+))?(/[^?#]*)?"
_SHORT = r"^([^@/:]+)@([^:/]+):([^?#]+)"


def with_metadata_uri(
    catalog: DataFrame,
    branch: str = "main",
    descriptor: str = "dataset.json",
    legacy: bool = False,
) -> tuple[DataFrame, DataFrame]:
    """(catalog with a derived metadata_uri, rows whose source is neither git nor s3)."""
    uri = metadata_uri(
        F.col("source"), F.coalesce("uri", F.lit("")), branch, descriptor, legacy
    )
    known = F.coalesce(F.col("source").isin("git", "s3"), F.lit(False))
    return catalog.filter(known).withColumn("metadata_uri", uri), catalog.filter(~known)


def parse_repo_urls(df: DataFrame, col: str, strip_blob: bool = False) -> DataFrame:
    """Add protocol, user, host, port, owner, name, path, resource and raw metadata_uri of repository URLs.

    ``resource`` is the path without its leading slash; a missing user or port is null.
    ``metadata_uri`` is null and ``supported`` false for other hosts.
    """
    url = F.col(col)
    short = url.rlike(_SHORT) & ~url.contains("://")
    part = df.withColumns(
        {
            "protocol": F.when(short, "ssh").otherwise(F.lower(F.regexp_extract(url, _LONG, 1))),
            "host": F.when(short, F.regexp_extract(url, _SHORT, 2)).otherwise(
                F.lower(F.regexp_extract(url, _LONG, 3))
            ),
            "user": F.nullif(
                F.when(short, F.regexp_extract(url, _SHORT, 1)).otherwise(F.regexp_extract(url, _LONG, 2)), F.lit("")
            ),
            "port": F.when(~short, F.nullif(F.regexp_extract(url, _LONG, 4), F.lit(""))).try_cast("int"),
            "path": F.when(short, F.concat(F.lit("/"), F.regexp_extract(url, _SHORT, 3))).otherwise(
                F.regexp_extract(url, _LONG, 5)
            ),
        }
    )
    raw_path = F.col("path")
    if strip_blob:
        raw_path = F.regexp_replace(raw_path, r"^(/[^/]+/[^/]+)/blob/", "$1/")
    base = F.lit(None).cast("string")
    for host, raw in RAW_HOSTS.items():
        base = F.when(F.col("host") == host, raw).otherwise(base)
    return part.withColumns(
        {
            "owner": F.regexp_extract("path", r"^/([^/]+)", 1),
            "resource": F.regexp_replace("path", "^/", ""),
            "name": F.regexp_replace(F.regexp_extract("path", r"^/[^/]+/([^/]+)", 1), r"\.git$", ""),
            "metadata_uri": F.concat(base, raw_path),
            "supported": base.isNotNull(),
        }
    )


def repo_hosts(parsed: DataFrame) -> DataFrame:
    """Number of URLs per host and owner."""
    return parsed.groupBy("host", "owner", "supported").agg(F.count("*").alias("n"))


def resolve_paths(
    catalog: DataFrame, folders: DataFrame, base: str, resources: DataFrame | None = None
) -> DataFrame:
    """(dataset_id, pos, name, path, kind, location, supported) of every resource.

    Local if the dataset's folder is in ``folders`` (column ``id``), else a URL next
    to the metadata for git, else the path as declared. The join runs on datasets,
    before their resources are unfolded, so a dataset with many files is one row.
    Resources may be a table of their own (dataset_id, pos, name, path) instead.
    """
    columns = ["id", "source", "metadata_uri", *([] if resources is not None else ["datapackage"])]
    if resources is not None:
        # a join follows, with which adaptive execution would not split this one
        spread = row_key(catalog)
        asked = catalog.select(*columns, *[F.col(c).alias(f"_{c}") for c in spread])
        found = flagged(asked, folders, "id", "_local", [f"_{c}" for c in spread])
    else:
        found = known(catalog.select(*columns), folders, "id", "_local")
    found = found.select(F.col("id").alias("dataset_id"), *columns[1:], "_local")
    if resources is not None:
        own = resources.select("dataset_id", "pos", F.struct("name", "path").alias("_r"))
        found = own.join(found, "dataset_id")
    else:
        found = found.select(
            "dataset_id", "source", "metadata_uri", "_local", F.posexplode_outer("datapackage.resources").alias("pos", "_r")
        ).filter(F.col("pos").isNotNull())
    path = F.coalesce("_r.path", F.lit(""))
    kind = F.when(F.col("_local"), "local").when(F.col("source") == "git", "git").otherwise("direct")
    return found.select(
        "dataset_id",
        F.col("pos").cast("long").alias("pos"),
        F.col("_r.name").alias("name"),
        path.alias("path"),
        kind.alias("kind"),
        F.when(F.col("_local"), F.concat(F.lit(base.rstrip("/") + "/"), "dataset_id", F.lit("/"), path))
        .when(F.col("source") == "git", F.concat(parent_uri(F.coalesce("metadata_uri", F.lit(""))), path))
        .otherwise(path)
        .alias("location"),
        (F.col("_local") | F.coalesce(F.col("source") == "git", F.lit(False))).alias("supported"),
    )


def legacy_urls(leaves: DataFrame, branch: str = "master") -> DataFrame:
    """Add ``url``: raw file URL from ``repository`` (owner/name) and ``path``."""
    return leaves.withColumn(
        "url",
        F.concat(F.lit("https://raw.githubusercontent.com/"), "repository", F.lit(f"/{branch}/"), "path"),
    )


def slug_index(catalog: DataFrame) -> DataFrame:
    """(id, slug): the page name of every dataset."""
    return catalog.select("id", slug(F.col("id")).alias("slug"))


def slug_collisions(catalog: DataFrame) -> DataFrame:
    """(slug, n) of page names shared by several datasets, which would overwrite each other."""
    return (
        slug_index(catalog).groupBy("slug").agg(F.count("*").alias("n")).filter(F.col("n") > 1)
    )


def with_collisions(catalog: DataFrame) -> DataFrame:
    """(id, slug, n): every dataset with the number of datasets that share its slug.

    Only colliding slugs are joined back; all others keep n = 1.
    """
    spread = row_key(catalog)
    slugs = catalog.select(*spread, slug(F.col("id")).alias("slug"))
    return salted_lookup(slugs, slug_collisions(catalog), "slug", spread).select(
        "id", "slug", F.coalesce("n", F.lit(1)).cast("long").alias("n")
    )


def with_format(files: DataFrame) -> DataFrame:
    """Add ``format`` from the extension of ``path``."""
    return files.withColumn("format", extension(F.col("path")))


def page_keywords(catalog: DataFrame, name: str = "keywords") -> DataFrame:
    """(id, keywords): the front-matter block of a dataset's tags."""
    return catalog.select("id", list_block(F.col("tags"), name).alias("keywords"))
