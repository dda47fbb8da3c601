from .readers import add_row_key, file_format, load, normalise_missing, read_csv
from .writers import save_table_csv, save_training, training_file_name

__all__ = ["add_row_key", "file_format", "load", "normalise_missing", "read_csv",
           "load_model", "save_model", "save_table_csv", "save_training", "training_file_name"]
