"""shelfmark: catalogs of datasets as Spark DataFrames."""

from .catalog import Catalog
from .functions.similarity import token_set_ratio
from .operators.index import search_indexed, write_search_index
from .operators.infer import (
    build_descriptors,
    build_leaves,
    cast_declared,
    cast_failures,
    csv_fields,
    infer_resources,
    infer_types,
    resource_failures,
)
from .operators.locate import (
    legacy_urls,
    page_keywords,
    parse_repo_urls,
    repo_hosts,
    resolve_paths,
    slug_collisions,
    slug_index,
    with_collisions,
    with_format,
    with_metadata_uri,
)
from .operators.lookup import (
    by_id_contained,
    by_ids,
    filter_report,
    get_dataset,
    list_folders,
    search_fields,
    select_resource,
)
from .operators.mutate import add, backfill, duplicate_ids, remove, repeated_fetches, union_catalogs, upsert
from .operators.position import dense_position
from .operators.search import result_count, search, search_score
from .operators.shape import (
    describe,
    explode_fields,
    explode_resources,
    flatten,
    full_metadata,
    normalize,
    resource_tree,
    summary,
    with_document,
)
from .operators.sync import sync_plan, sync_summary
from .operators.validate import (
    explode_leaves,
    field_counts,
    roll_up,
    validate,
    validate_catalog,
    validate_descriptors,
)
from .schema import DATASET, LEAF, RESOURCE, to_fields, to_struct
from .session import session
from .sinks.catalogs import (
    create_catalog,
    export_catalog_dir,
    write_catalog,
    write_catalog_array,
    write_catalog_dir,
    write_catalog_json,
)
from .sinks.materialize import materialize, materialize_many
from .sinks.pages import render_pages, write_pages
from .sources.catalogs import (
    catalog_from_responses,
    read_catalog,
    read_catalog_dir,
    read_catalog_json,
    read_catalog_json_blocks,
    read_catalog_lines,
)
from .sources.files import list_files
from .sources.tables import read_delimited, read_json_resource, read_resource
