from tessera.sources.files import (  # noqa: F401
    clean_headers, clean_name, read_csv, read_delimited, read_headerless,
    read_slices, read_table, write_slices,
)
