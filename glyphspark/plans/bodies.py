"""JSON bodies against a declared shape: what is malformed, missing, null or of another type told apart, at any depth.

A body is parsed once, as a variant. A Path names a place by its keys, joined by dots, and "[]" for every item of an array.
Issues read "path: what is wrong", in the order of the paths, items by their number. A place whose parent is missing or of
another kind is not looked at: its parent's issue says so.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Path:
    """kind: string, number, boolean, array, object. optional: may be missing; nullable: may be null. least and most bound
    numbers, and the length of strings and arrays; whole numbers only where whole is set."""

    name: str
    kind: str
    optional: bool = False
    nullable: bool = False
    least: int | None = None
    most: int | None = None
    options: tuple[str, ...] = ()
    whole: bool = False


#: The words of issues.
INVALID, SMALL, BIG = "Invalid input: expected {}, received {}", "Too small: expected {} to {} {}", "Too big: expected {} to {} {}"
MALFORMED = "body: Malformed JSON"


def kind_of(value: Column) -> Column:
    """undefined, null, or the kind of a variant."""
    name = F.schema_of_variant(value)
    kind = F.when(name.startswith("OBJECT"), "object").when(name.startswith("ARRAY"), "array").when(name == "STRING", "string").when(name == "BOOLEAN", "boolean").otherwise("number")
    return F.when(value.isNull(), "undefined").when(F.is_variant_null(value), "null").otherwise(kind)


def _bound(p: Path, value: Column) -> Column:
    """What a bound says of a value of the right kind, or null."""
    said = F.lit(None).cast("string")
    if p.options:
        text = F.try_variant_get(value, "$", "string")
        choice = "Invalid option: expected one of " + "|".join(f'"{o}"' for o in p.options)
        return F.when(~text.isin(*p.options), choice)
    size = {"string": lambda: F.length(F.try_variant_get(value, "$", "string")), "array": lambda: F.size(F.try_variant_get(value, "$", "array<variant>"))}.get(p.kind, lambda: F.try_variant_get(value, "$", "double"))()
    unit = {"string": "have", "array": "have"}.get(p.kind, "be")
    tail = {"string": " characters", "array": " items"}.get(p.kind, "")
    if p.whole:
        said = F.when(size != F.floor(size), INVALID.format("int", "number")).otherwise(said)
    if p.most is not None:
        said = F.when(size > p.most, BIG.format(p.kind, unit, f"<={p.most}{tail}")).otherwise(said)
    if p.least is not None:
        said = F.when(size < p.least, SMALL.format(p.kind, unit, f">={p.least}{tail}")).otherwise(said)
    return said


def _issue(p: Path, value: Column) -> Column:
    kind = kind_of(value)
    wrong = F.concat(F.lit(INVALID.format(p.kind, "")), kind)
    passed = F.lit(False)
    if p.optional:
        passed = passed | (kind == "undefined")
    if p.nullable:
        passed = passed | (kind == "null")
    return F.when(passed, None).when(kind != p.kind, wrong).otherwise(_bound(p, value))


def issues(body: Column, paths: tuple[Path, ...]) -> Column:
    """array<string> of what is wrong with a JSON text; one issue for a malformed or null one."""
    whole = F.try_parse_json(body)

    def at(p: Path) -> Column:
        """array<string> of the issues of one path."""
        if "[]" in p.name:
            above, _, rest = p.name.partition("[]")
            if "[]" in rest:
                raise ValueError("one [] to a path")
            items = F.try_variant_get(whole, f"$.{above}", "array<variant>")

            def one(item: Column, k: Column) -> Column:
                value = F.try_variant_get(item, f"${rest}", "variant") if rest else item
                skip = kind_of(item) != "object" if rest else F.lit(False)
                return F.when(~skip, F.concat(F.lit(f"{above}."), k.cast("string"), F.lit(f"{rest}: "), _issue(p, value)))

            return F.coalesce(F.array_compact(F.transform(items, one)), F.array().cast("array<string>"))
        parent = p.name.rpartition(".")[0]
        there = kind_of(F.try_variant_get(whole, f"$.{parent}" if parent else "$", "variant")) == "object"
        return F.array_compact(F.array(F.when(there, F.concat(F.lit(f"{p.name}: "), _issue(p, F.try_variant_get(whole, f"$.{p.name}", "variant"))))))

    root = F.array_compact(F.array(F.when(kind_of(whole) != "object", F.concat(F.lit(f"body: {INVALID.format('object', '')}"), kind_of(whole)))))
    return F.when(whole.isNull(), F.array(F.lit(MALFORMED))).otherwise(F.concat(root, *[at(p) for p in paths]))


def parsed(rows: DataFrame, column: str, fields: dict[str, tuple[str, str]], paths: tuple[Path, ...]) -> DataFrame:
    """rows with fields of their body (name: path and type; null where there is no such value) and its issues."""
    body = F.try_parse_json(column)
    made = {name: F.try_variant_get(body, f"$.{path}", kind) for name, (path, kind) in fields.items()}
    return rows.withColumns(made | {"issues": issues(F.col(column), paths)})
