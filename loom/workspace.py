"""The working table.

The reference keeps two positionally aligned copies of one table: a *display*
copy (raw values, used for statistics and exploration) and a *training* copy
(what the model sees).  Here both live in ONE DataFrame so they can never drift
apart and no positional join is ever needed:

* ``key``            - a unique row key supplied by the caller (or derived, see
                       ``sources.readers.add_row_key``);
* ``<name>``         - raw (display) feature columns;
* ``<name>__w``      - working (training) copy, once it differs from the raw one;
* ``<name>__orig``   - original values kept by a numeric -> categorical
                       conversion, so the conversion can be undone.

A ``Workspace`` is an immutable value: each operator returns a new one.
``submit()`` freezes it (the reference locks editing after submission).
"""

from __future__ import annotations

import warnings
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame

from . import session as S
from .functions.stats import col

WSUF = "__w"
OSUF = "__orig"


def wname(name: str) -> str:
    return name + WSUF


@dataclass(frozen=True)
class Workspace:
    """Raw and working copies of one table in one DataFrame.

    A working column shares the raw column until an operator changes only the
    working copy (scaling, encoding); then it gets its own physical column
    ``<name>__w``.  Sharing keeps plans narrow and free of alias chains.
    """

    df: DataFrame
    key: str | None
    raw: tuple[str, ...]
    work: tuple[str, ...]
    phys: dict = field(default_factory=dict)  # working name -> physical column (default: same name)
    tags: dict = field(default_factory=dict)  # working column -> frozenset of {"scaled", "encoded", "log"}
    frozen: bool = False
    target: str | None = None
    y: str = "y"                     # column of the encoded target, once one is selected
    y_label: str = "y_label"         # column of the raw target
    split: str = "split"             # column that says 'train' or 'test', once the rows are split

    # construction -----------------------------------------------------------------
    @classmethod
    def from_df(cls, df: DataFrame, key: str | None = None) -> "Workspace":
        """Start (or replace) a workspace: both copies set to the loaded table.

        ``key`` is a unique row key; it is only required by the sampling operators.
        """
        if key is not None and key not in df.columns:
            raise ValueError(f"key column {key!r} not in table")
        feats = [c for c in df.columns if c != key]
        return cls(df, key, tuple(feats), tuple(feats), {}, {})

    # physical names ---------------------------------------------------------------
    def wcol(self, name: str) -> str:
        """Physical column holding the working copy of ``name``."""
        return self.phys.get(name, name)

    def shared(self, name: str) -> bool:
        return name in self.raw and self.wcol(name) == name

    # views ------------------------------------------------------------------------
    def display(self) -> DataFrame:
        """Raw copy: key + raw feature columns."""
        return self.df.select(*self._keys(), *[col(c) for c in self.raw])

    def working_columns(self) -> list:
        return [col(self.wcol(c)).alias(c) if self.wcol(c) != c else col(c) for c in self.work]

    def working(self, extra=()) -> DataFrame:
        """Training copy: key + working columns under their logical names (+ target columns)."""
        tgt = [c for c in (self.y, self.y_label) if self.target is not None and c in self.df.columns]
        return self.df.select(*self._keys(), *self.working_columns(), *[col(c) for c in tgt],
                              *[col(c) for c in extra])

    def _keys(self):
        return [col(self.key)] if self.key else []

    # rewriting --------------------------------------------------------------------
    def apply(self, work: dict | None = None, both: dict | None = None, metadata: dict | None = None,
              drop=(), raw: dict | None = None, **changes) -> "Workspace":
        """Rewrite columns in one projection.

        ``work``: name -> fn(Column) applied to the working copy only (a shared
        column is split off first).  ``both``: name -> fn(Column) applied to the
        raw and the working copy (one column while they are shared).
        ``metadata``: physical name -> column metadata.  ``drop``: physical names.
        """
        replace, add = {}, []
        phys = dict(changes.pop("phys", self.phys))
        for c, fn in (both or {}).items():
            if c in self.raw:
                replace[c] = fn(col(c))
            if c in self.work and self.wcol(c) != c:
                replace[self.wcol(c)] = fn(col(self.wcol(c)))
        for c, fn in (raw or {}).items():
            if self.shared(c) and c in self.work:  # keep the old value as the working copy
                phys[c] = wname(c)
                add.append((wname(c), col(c)))
            replace[c] = fn(col(c))
        for c, fn in (work or {}).items():
            p = self.wcol(c)
            expr = fn(col(p))
            if p == c and c in self.raw:
                phys[c] = wname(c)
                add.append((wname(c), expr))
            else:
                replace[p] = expr
        md = metadata or {}

        def out(name, expr):
            return expr.alias(name, metadata=md[name]) if name in md else expr.alias(name)

        cols = [out(x, replace[x]) if x in replace else col(x) for x in self.df.columns if x not in drop]
        cols += [out(n, e) for n, e in add]
        return replace_self(self, df=self.df.select(*cols), phys=phys, **changes)

    # helpers for operators --------------------------------------------------------
    def check_open(self) -> None:
        if self.frozen:
            raise ValueError("the workspace was submitted; edits are locked")

    def evolve(self, df: DataFrame, **changes) -> "Workspace":
        return replace(self, df=df, **changes)

    def tag(self, cols, label: str) -> dict:
        tags = dict(self.tags)
        for c in cols:
            tags[c] = frozenset(tags.get(c, frozenset()) | {label})
        return tags

    def warn_if_transformed(self, name: str, action: str) -> None:
        t = self.tags.get(name, frozenset())
        if t & {"scaled", "encoded", "log"}:
            warnings.warn(f"{action} writes a raw-scale value into the already transformed working column {name!r}")

    def submit(self) -> "Workspace":
        return replace(self, frozen=True)

    def persist(self) -> "Workspace":
        """Cut lineage after an expensive prefix (reliable checkpoint in the shared folder)."""
        return replace(self, df=S.cut_lineage(self.df))

    def require(self, names, where: str = "raw") -> None:
        pool = self.raw if where == "raw" else self.work
        missing = [n for n in names if n not in pool]
        if missing:
            raise ValueError(f"unknown column(s): {missing}")


def replace_self(ws: Workspace, **changes) -> Workspace:
    return replace(ws, **changes)
