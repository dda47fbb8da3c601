"""loom: data preparation, exploration and model evaluation on Spark DataFrames."""

from .session import cut_lineage, ensure_checkpoint_dir, local_session
from .workspace import Workspace

__all__ = ["Workspace", "cut_lineage", "ensure_checkpoint_dir", "local_session"]
