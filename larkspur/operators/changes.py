"""Plans of schema changes: which steps, in which order, how safe each is by its types and by the data, what reads the column, and how to go back.

Nothing is changed here: a plan is a DataFrame, and applied() and rolled_back() give new DataFrames.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: From the best to the worst; the verdict of several is the worst of them.
VERDICTS = ("SAFE", "LOSSY", "HIGH_RISK", "UNSUPPORTED")
#: What becomes of a step by its verdict.
DISPOSITIONS = {"SAFE": "APPLY", "LOSSY": "REVIEW", "HIGH_RISK": "REVIEW", "UNSUPPORTED": "BLOCKED", "METADATA_NOT_FOUND": "BLOCKED", "RENAME_COLLISION": "BLOCKED", "PROTECTED": "BLOCKED"}
#: Digits that every value of an integer type needs, and that it surely holds.
INTEGERS = {T.ByteType: (3, 2), T.ShortType: (5, 4), T.IntegerType: (10, 9), T.LongType: (19, 18)}
#: Decimal digits that a floating type holds exactly.
FLOATS = {T.FloatType: 6, T.DoubleType: 15}
TIMES = (T.TimestampType, T.TimestampNTZType)


@dataclass(frozen=True)
class Change:
    """A new type, a new name, or both, for one column."""

    table: str
    column: str
    new_type: str | None = None
    new_name: str | None = None


@dataclass(frozen=True)
class Step:
    """action: CAST or RENAME, of `column` as it is called at that time; or ADAPT, of a query that reads changed columns (`column` is the query's name)."""

    table: str
    column: str
    action: str
    old: str
    new: str
    verdict: str
    origin: str = ""  # the column's name before all changes
    checks: dict = field(default_factory=dict, compare=False)

    @property
    def disposition(self) -> str:
        return DISPOSITIONS[self.verdict]


def worst(verdicts) -> str:
    return VERDICTS[max([VERDICTS.index(v) for v in verdicts], default=0)]


def _digits(t: T.DataType) -> tuple[int, int, int] | None:
    """Of an exact number: digits before the point that it needs, that it holds, and digits after it."""
    if type(t) in INTEGERS:
        return (*INTEGERS[type(t)], 0)
    if isinstance(t, T.DecimalType):
        return t.precision - t.scale, t.precision - t.scale, t.scale
    return None


def cast_safety(old: T.DataType, new: T.DataType) -> str:
    """How safe a cast is by its types alone.

    SAFE: every value is held exactly. LOSSY: all values have a place, some lose digits or detail. HIGH_RISK: some values may have none, and fail or become null. UNSUPPORTED: there is no cast.
    Of arrays, maps and structs the worst of their parts counts.
    """
    if old == new or isinstance(old, T.NullType):
        return "SAFE"
    if isinstance(old, T.ArrayType) and isinstance(new, T.ArrayType):
        return worst([cast_safety(old.elementType, new.elementType), "HIGH_RISK" if old.containsNull and not new.containsNull else "SAFE"])
    if isinstance(old, T.MapType) and isinstance(new, T.MapType):
        return worst([cast_safety(old.keyType, new.keyType), cast_safety(old.valueType, new.valueType)])
    if isinstance(old, T.StructType) and isinstance(new, T.StructType):
        return worst([cast_safety(a.dataType, b.dataType) for a, b in zip(old, new)]) if len(old) == len(new) else "UNSUPPORTED"
    if isinstance(old, T.ArrayType | T.MapType | T.StructType) or isinstance(new, T.ArrayType | T.MapType | T.StructType):
        return "UNSUPPORTED"
    text, number = isinstance(new, T.StringType), lambda t: _digits(t) is not None or type(t) in FLOATS
    if isinstance(old, T.StringType):
        return "SAFE" if text or isinstance(new, T.BinaryType) else "HIGH_RISK"
    if text:
        return "HIGH_RISK" if isinstance(old, T.BinaryType) else "SAFE"
    if number(old) and number(new):
        a, b = _digits(old), _digits(new)
        if a and b:
            return "HIGH_RISK" if a[0] > b[1] else "LOSSY" if a[2] > b[2] else "SAFE"
        if a:
            return "SAFE" if not a[2] and a[0] <= FLOATS[type(new)] else "LOSSY"
        if b:
            return "HIGH_RISK"  # a float may be of any size
        return "SAFE" if isinstance(new, T.DoubleType) else "LOSSY"
    if isinstance(old, T.BooleanType) and number(new):
        return "SAFE"
    if number(old) and isinstance(new, T.BooleanType):
        return "LOSSY"
    if isinstance(old, T.DateType) and isinstance(new, TIMES):
        return "SAFE"
    if isinstance(old, TIMES) and isinstance(new, (T.DateType, *TIMES)):
        return "LOSSY"  # the time of day, or the zone
    return "UNSUPPORTED"


def _type(text: str) -> T.DataType:
    return T.StructType.fromDDL(f"c {text}")[0].dataType


def _profiled(df: DataFrame, casts: list[Step]) -> dict[str, tuple[int, int, int]]:
    """Of each cast of a table: rows, rows whose value comes back otherwise, and rows whose value has no place in the new type. One scan for all casts."""
    counts = [F.count("*").alias("n")]
    for k, s in enumerate(casts):
        old, new = F.col(f"`{s.origin}`"), F.col(f"`{s.origin}`").try_cast(s.new)
        failed = old.isNotNull() & new.isNull()
        back = new.try_cast(df.schema[s.origin].dataType)
        counts += [F.count_if(old.isNotNull() & ~failed & ~back.eqNullSafe(old)).alias(f"changed{k}"), F.count_if(failed).alias(f"failed{k}")]
    row = df.agg(*counts).first()
    return {s.origin: (row["n"], row[f"changed{k}"], row[f"failed{k}"]) for k, s in enumerate(casts)}


def _renames_in_order(table: str, columns: list[str], wanted: dict[str, str]) -> list[tuple[str, str, str]]:
    """(column at that time, new name, origin): a name is given up before it is taken; a circle goes over a name that is free."""
    now, todo, out = {c: c for c in columns}, dict(wanted), []
    while todo:
        taken = set(now.values())
        free = next((c for c, n in todo.items() if n not in taken), None)
        if free is not None:
            out.append((now[free], todo[free], free))
            now[free] = todo.pop(free)
            continue
        first = next(iter(todo))  # all that are left wait for each other
        spare = next(s for k in range(len(columns) + 1) if (s := f"{now[first]}_{k}") not in taken)
        out.append((now[first], spare, first))
        now[first] = spare
    return out


def _parents_first(columns: list[tuple[str, str]], foreign_keys: list[tuple[str, str, str, str]]) -> list[tuple[str, str]]:
    """Columns so that a referenced key comes before the columns that refer to it; else as given. Circles of references are cut where they are met."""
    out: list[tuple[str, str]] = []
    parents = {}
    for child, column, parent, key in foreign_keys:
        parents.setdefault((child, column), []).append((parent, key))

    def visit(node: tuple[str, str], above: tuple) -> None:
        for p in parents.get(node, []):
            if p in columns and p not in above:
                visit(p, (*above, node))
        if node not in out:
            out.append(node)

    for c in columns:
        visit(c, ())
    return out


def planned_steps(tables: Mapping[str, DataFrame], changes: list[Change], protected: frozenset[str] = frozenset(), foreign_keys: list[tuple[str, str, str, str]] = (), readers: Mapping[str, set[tuple[str, str]]] | None = None, profile: bool = True) -> list[Step]:
    """The steps in order: all casts, keys before what refers to them; then all renames, no name taken before it is free; then the queries that read a changed column.

    readers: by query the (table, column) pairs it reads. A change of a protected table or an unknown column, and a name that another column keeps, become steps that are blocked, as do casts that there are none of.
    A cast that is blocked doesn't block the renaming of its column. With profile each cast is tried on all rows of its table.
    """
    blocked, casts, renames = [], {}, {}
    for c in changes:
        if c.table in protected or c.table not in tables or c.column not in tables[c.table].columns:
            verdict = "PROTECTED" if c.table in protected else "METADATA_NOT_FOUND"
            blocked += [Step(c.table, c.column, a, "", new, verdict, c.column) for a, new in (("CAST", c.new_type), ("RENAME", c.new_name)) if new]
            continue
        if c.new_type:
            old, new = tables[c.table].schema[c.column].dataType, _type(c.new_type)
            casts[c.table, c.column] = Step(c.table, c.column, "CAST", old.simpleString(), new.simpleString(), cast_safety(old, new), c.column)
        if c.new_name and c.new_name != c.column:
            renames.setdefault(c.table, {})[c.column] = c.new_name
    for table, wanted in renames.items():
        while True:  # what is blocked keeps its name, which can block others
            kept = set(tables[table].columns) - set(wanted)
            twice = [c for k, (c, n) in enumerate(wanted.items()) if n in kept or n in list(wanted.values())[:k]]
            if not twice:
                break
            blocked += [Step(table, c, "RENAME", c, wanted.pop(c), "RENAME_COLLISION", c) for c in twice]
    steps = [casts[k] for k in _parents_first(list(casts), list(foreign_keys))]
    if profile:
        for table in dict.fromkeys(s.table for s in steps):
            mine = [s for s in steps if s.table == table and s.verdict != "UNSUPPORTED"]
            for column, found in (_profiled(tables[table], mine) if mine else {}).items():
                casts[table, column].checks.update(zip(("rows_checked", "rows_changed", "rows_failed"), found))
    steps += [Step(table, now, "RENAME", now, new, "SAFE", origin) for table, wanted in renames.items() for now, new, origin in _renames_in_order(table, tables[table].columns, wanted)]
    touched: dict[tuple[str, str], str] = {}
    for s in steps:
        touched[s.table, s.origin] = worst([s.verdict, touched.get((s.table, s.origin), "SAFE")])
    adapt = []
    for query, columns in sorted((readers or {}).items()):
        if hit := sorted(columns & set(touched)):
            adapt.append(Step("", query, "ADAPT", ", ".join(f"{t}.{c}" for t, c in hit), "", worst(touched[h] for h in hit), query))
    return steps + blocked + adapt


def runnable(steps: list[Step]) -> list[Step]:
    return [s for s in steps if s.action != "ADAPT" and s.disposition != "BLOCKED"]


def plan_rows(spark: SparkSession, steps: list[Step]) -> DataFrame:
    """The plan as rows: step and rollback_step (null where nothing runs), table_name, column_name, action, from_value, to_value, verdict, disposition, the counts of the profile, statement and rollback.

    Rolling back runs the rollback statements by rollback_step: the last step is undone first.
    """
    run, rows = runnable(steps), []
    for s in steps:
        k = run.index(s) if s in run else None
        alter = f"ALTER TABLE {s.table} "
        do = undo = None
        if k is not None and s.action == "CAST":
            do, undo = (f"{alter}ALTER COLUMN {s.column} TYPE {t}" for t in (s.new, s.old))
        elif k is not None:
            do, undo = f"{alter}RENAME COLUMN {s.old} TO {s.new}", f"{alter}RENAME COLUMN {s.new} TO {s.old}"
        counts = [s.checks.get(c) for c in ("rows_checked", "rows_changed", "rows_failed")]
        rows.append((None if k is None else k + 1, None if k is None else len(run) - k, s.table or None, s.column, s.action, s.old or None, s.new or None, s.verdict, s.disposition, *counts, do, undo))
    schema = "step int, rollback_step int, table_name string, column_name string, action string, from_value string, to_value string, verdict string, disposition string, rows_checked long, rows_changed long, rows_failed long, statement string, rollback string"
    return spark.createDataFrame(rows, schema)


def applied(tables: Mapping[str, DataFrame], steps: list[Step]) -> dict[str, DataFrame]:
    """The tables after the steps that run. Values without a place in a new type become null. Other columns, and the order of columns, stay."""
    out = dict(tables)
    for s in runnable(steps):
        df = out[s.table]
        out[s.table] = df.withColumn(s.column, F.col(f"`{s.column}`").try_cast(s.new)) if s.action == "CAST" else df.withColumnRenamed(s.old, s.new)
    return out


def rolled_back(tables: Mapping[str, DataFrame], steps: list[Step]) -> dict[str, DataFrame]:
    """applied() undone, the last step first: the old names and types, and the old values wherever the profile of a cast counts no change and no failure. Queries written for the old schema run on this."""
    out = dict(tables)
    for s in reversed(runnable(steps)):
        df = out[s.table]
        out[s.table] = df.withColumn(s.column, F.col(f"`{s.column}`").try_cast(s.old)) if s.action == "CAST" else df.withColumnRenamed(s.new, s.old)
    return out
