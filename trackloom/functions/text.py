"""Labels, symbols, atoms and clauses as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Motion words with one of five canonical classes
LABEL_ALIASES = {
    "moving_forward": "forward",
    "forward": "forward",
    "driving_forward": "forward",
    "moving_backward": "backward",
    "backward": "backward",
    "driving_backward": "backward",
    "turning_left": "left",
    "turn_left": "left",
    "left": "left",
    "turning_right": "right",
    "turn_right": "right",
    "right": "right",
    "stationary": "static",
    "stopping": "static",
    "stopped": "static",
    "stop": "static",
    "static": "static",
}
LEFT_WORDS = ["left", "turning_left", "turn_left"]
RIGHT_WORDS = ["right", "turning_right", "turn_right"]
STATIC_WORDS = ["stop", "stopping", "stopped", "stationary", "static"]


def clean_label(value: Column) -> Column:
    """Lower case, other characters to single underscores, no underscores at the ends."""
    folded = F.regexp_replace(F.lower(F.trim(F.coalesce(value, F.lit("")))), "[^a-z0-9]+", "_")
    return F.regexp_replace(folded, "^_+|_+$", "")


def symbol(value: Column) -> Column:
    text = F.regexp_replace(
        F.lower(F.trim(F.when(F.coalesce(value, F.lit("")) != "", value).otherwise("unknown"))), "[^a-z0-9_]+", "_"
    )
    text = F.regexp_replace(F.regexp_replace(text, "_+", "_"), "^_|_$", "")
    text = F.when(text == "", "unknown").otherwise(text)
    return F.when(text.rlike("^[0-9]"), F.concat(F.lit("n_"), text)).otherwise(text)


def class_token(value: Column, aliases: dict[str, str]) -> Column:
    token = clean_label(value)
    token = F.when(token == "", "unknown").otherwise(token)
    out = token
    for alias, name in aliases.items():
        out = F.when(token == alias, name).otherwise(out)
    return out


def combined_label(forward: Column, lateral: Column) -> Column:
    return F.concat_ws("|", forward, lateral)


def split_label(value: Column) -> tuple[Column, Column]:
    parts = F.split(value, r"\|", 2)
    return parts[0], F.coalesce(F.get(parts, F.lit(1)), F.lit("straightforward"))


def canonical_motion(value: Column, forward: Column | None = None, lateral: Column | None = None) -> Column:
    """One of forward, backward, left, right, static; a turn wins over the longitudinal state."""
    text = clean_label(value)
    has_pair = value.contains("|")
    halves = F.split(value, r"\|", 2)

    def part(given: Column | None, index: int) -> Column:
        from_pair = F.when(has_pair, clean_label(F.get(halves, F.lit(index)))).otherwise("")
        if given is None:
            return from_pair
        cleaned = clean_label(given)
        return F.when(cleaned != "", cleaned).otherwise(from_pair)

    fwd, lat = part(forward, 0), part(lateral, 1)
    direct = F.lit(None).cast("string")
    for alias, name in LABEL_ALIASES.items():
        direct = F.when(text == alias, name).otherwise(direct)
    inferred = (
        F.when(lat.isin(LEFT_WORDS) | text.contains("turning_left"), "left")
        .when(lat.isin(RIGHT_WORDS) | text.contains("turning_right"), "right")
        .when(fwd.startswith("backward") | text.startswith("backward"), "backward")
        .when(fwd.isin(STATIC_WORDS), "static")
        .when(fwd.rlike("forward|speedup|slowdown|moving") | text.rlike("forward|speedup|slowdown"), "forward")
    )
    return F.coalesce(direct, inferred)


def make_atom(predicate, *args: Column) -> Column:
    name = F.lit(predicate) if isinstance(predicate, str) else predicate
    return F.concat(name, F.lit("("), F.concat_ws(",", *args), F.lit(")."))


def atom_predicate(atom: Column) -> Column:
    return F.regexp_extract(atom, r"^\s*([A-Za-z0-9_]+)\(", 1)


def atom_args(atom: Column) -> Column:
    inner = F.regexp_extract(atom, r"\((.*)\)", 1)
    return F.transform(F.split(inner, ","), lambda a: F.trim(a))


def template_bindings(template: Column, atom: Column) -> Column:
    """Map variable -> constant, or null when the atom does not fit (repeated variables must agree)."""

    def bind(parts: Column) -> Column:
        pairs = F.zip_with(parts["t"], parts["a"], lambda t, a: F.struct(t.alias("v"), a.alias("c")))
        return F.struct(
            F.array_distinct(F.filter(pairs, lambda p: p["v"].rlike("^[A-Z]$"))).alias("bound"),
            F.forall(pairs, lambda p: p["v"].rlike("^[A-Z]$") | (p["v"] == p["c"])).alias("constants_agree"),
        )

    def as_map(b: Column) -> Column:
        names = F.array_distinct(b["bound"]["v"])
        fits = b["constants_agree"] & (F.size(names) == F.size(b["bound"]))
        return F.when(fits, F.map_from_entries(b["bound"]))

    parts = F.struct(atom_args(template).alias("t"), atom_args(atom).alias("a"))
    same_predicate = atom_predicate(template) == atom_predicate(atom)
    # one-element arrays name an intermediate value so that it is computed once
    sized = F.filter(F.array(parts), lambda p: same_predicate & (F.size(p["t"]) == F.size(p["a"])))
    return F.get(F.transform(F.transform(sized, bind), as_map), F.lit(0))


def canonical_body(templates: Column) -> Column:
    return F.array_sort(F.array_distinct(templates))


def clause(head: Column, templates: Column) -> Column:
    """``head(S) :- a, b.`` with sorted distinct body atoms."""
    atoms = F.transform(canonical_body(templates), lambda t: F.regexp_replace(t, r"\.$", ""))
    return F.concat(head, F.lit("(S) :- "), F.array_join(atoms, ", "), F.lit("."))


def clause_head(text: Column) -> Column:
    return F.trim(F.substring_index(text, ":-", 1))


def clause_body(text: Column) -> Column:
    """Body atoms of a clause; commas inside parentheses do not split."""
    return F.regexp_extract_all(F.substring_index(text, ":-", -1), F.lit(r"([A-Za-z0-9_]+\([^)]*\))"), 1)


def list_like(value: Column) -> Column:
    """Array of strings from JSON list text; anything else is an empty list."""
    return F.coalesce(F.from_json(value, "array<string>"), F.array().cast("array<string>"))


def truthy(value: Column) -> Column:
    return F.coalesce(F.lower(F.trim(value)).isin("1", "true", "yes"), F.lit(False))


def number_or(value: Column, default: float) -> Column:
    return F.coalesce(value.try_cast("double"), F.lit(default))


def detection_id(frame: Column, collection: Column, index: Column) -> Column:
    return F.concat(
        F.lpad(frame.cast("string"), 6, "0"), F.lit(":"), collection, F.lit(":"), F.lpad(index.cast("string"), 4, "0")
    )


# Prefixes of constants and the variables that stand for them, first match wins
VARIABLE_PREFIXES = [("seg_", "S"), ("obj_candidate_", "C"), ("obj_", "O"), ("track_", "T"), ("frame_", "F")]


def abstract_atom(atom: Column) -> Column:
    def variable(arg: Column) -> Column:
        out = arg
        for prefix, name in reversed(VARIABLE_PREFIXES):
            out = F.when(arg.startswith(prefix), name).otherwise(out)
        return out

    args = F.transform(atom_args(atom), variable)
    return F.concat(atom_predicate(atom), F.lit("("), F.array_join(args, ","), F.lit(")."))
