from cohortia.sources.readers import (read_csv, read_delimited, read_parquet, read_seed_results,
                                      read_semicolon, read_table, read_tsv, read_blanks)
from cohortia.sources.sinks import load_table, save_model, save_table, write_csv, write_tsv

__all__ = ["read_csv", "read_delimited", "read_parquet", "read_seed_results", "read_semicolon",
           "read_table", "read_tsv", "read_blanks", "load_table", "save_model", "save_table",
           "write_csv", "write_tsv"]
