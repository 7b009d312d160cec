"""What the operators of this subpackage take from the core."""

from __future__ import annotations

from stipple.lineage import cut, dropped, ensure_checkpoint_dir, folder, partitions, removed, written
from stipple.operators.model import current_rows, finite

__all__ = ["current_rows", "cut", "dropped", "ensure_checkpoint_dir", "finite", "folder", "partitions", "removed", "written"]
