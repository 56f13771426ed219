from cartsight.sources.imports import Import, import_csv
from cartsight.sources.monthly_csv import read_monthly
from cartsight.sources.store import FileStore, SampleStore, TableStore
from cartsight.sources.stored import (
    materialise,
    new_table_name,
    shared_folder,
    store_and_read,
    write_folder,
)
from cartsight.sources.versions import add_column, publish, retire, store_partitioned, update, versions
from cartsight.sources.views import drop_views, store_view, view, view_key

__all__ = [
    "FileStore",
    "Import",
    "SampleStore",
    "TableStore",
    "add_column",
    "drop_views",
    "import_csv",
    "materialise",
    "new_table_name",
    "publish",
    "read_monthly",
    "retire",
    "shared_folder",
    "store_and_read",
    "store_partitioned",
    "store_view",
    "update",
    "versions",
    "view",
    "view_key",
    "write_folder",
]
