"""Text expressions: markers, lines, escapes, counts, imports. Built-in functions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The markers of a prompt document.
EXECUTED, CELL, RUNTIME, TARGET, NOTHING = "# Executed Cells:\n", "## Cell ", "# Current relevent runtime information:\n", "# Target Cell:\n", "No cell has been executed\n"
#: ANSI escape sequences; the place of a crash in a traceback.
ANSI = "\\x1B(?:[@-Z\\\\-_]|\\[[0-?]*[ -/]*[@-~])"
CRASH = "<ipython-input-(\\d+)-[\\da-f]+> in <cell line: (\\d+)>"
#: Representations that no literal parser can read, and what stands for them.
OBJECT_REPR, TORCH_SIZE, DEFAULTDICT, DTYPE = "<[^>]+object at 0x[a-fA-F0-9]+>", "torch\\.Size\\([^)]*\\)", "defaultdict\\([^)]*\\)", "dtype\\('([^']+)'\\)"


def without_ansi(text: Column) -> Column:
    return F.regexp_replace(text, ANSI, "")


def lines_of(text: Column) -> Column:
    return F.split(text, "\\r?\\n", -1)


def line_at(text: Column, number: Column) -> Column:
    """The line with this 1-based number; null outside."""
    n = number.cast("int")
    return F.when(n >= 1, F.try_element_at(F.split(text, "\n", -1), F.when(n >= 1, n).otherwise(1)))


def crash_line(traceback: Column, source: Column) -> Column:
    """The stripped source line a traceback names; null if it names none in range."""
    number = F.regexp_extract(without_ansi(traceback), CRASH, 2).try_cast("int")
    return F.trim(line_at(source, number))


def between(text: Column, start: str, end: str, whole: bool = True, to_the_end: bool = True) -> Column:
    """What stands from `start` to `end`. whole: with the start marker; to_the_end: a missing end marker means the text's end, else null. Null without the start marker."""
    at, stop = F.instr(text, start), F.instr(text, end)
    first = at if whole else at + len(start)
    upto = F.when(stop > 0, stop).otherwise(F.length(text) + 1 if to_the_end else None)
    return F.when((at > 0) & upto.isNotNull(), F.substring(text, first, F.greatest(upto - first, F.lit(0))))


def scrubbed(runtime: Column) -> Column:
    """Runtime information with unreadable representations replaced."""
    out = F.regexp_replace(runtime, DTYPE, "'$1'")
    out = F.regexp_replace(out, OBJECT_REPR, '"<object>"')
    out = F.regexp_replace(out, TORCH_SIZE, '"<torch.Size>"')
    return F.regexp_replace(out, DEFAULTDICT, "{}")


def found_types(runtime: Column) -> Column:
    """(name, type) by patterns, for runtime information that is no literal: plain types, then class representations, which win; by the first place of each name."""
    # The forms of an entry.
    plain = "'([^']+)':\\s*\\{[^{}]*'type':\\s*[\"']([^\"'<>]+)[\"'][^{}]*\\}"
    shown = "'([^']+)':\\s*\\{[^{}]*'type':\\s*[\"']<class\\s+'([^\"'>]+)'>[\"'][^{}]*\\}"
    entry = lambda x, form: F.struct(x["first"].alias("name"), F.format_string(form, x["second"]).alias("type"))
    usable = lambda x: F.trim(x["second"]) != ""
    first = F.transform(F.filter(pairs_of(runtime, plain), lambda x: usable(x) & ~F.startswith(x["first"], F.lit("__method__"))), lambda x: entry(x, "%s"))
    name = lambda x: (F.instr(x["second"], ".") > 0) | x["second"].rlike("^[^\\W\\d]\\w*$")
    second = F.transform(F.filter(pairs_of(runtime, shown), lambda x: usable(x) & name(x) & ~F.startswith(x["first"], F.lit("__method__"))), lambda x: entry(x, "<class '%s'>"))
    both = F.concat(first, second)
    names = F.array_distinct(F.transform(both, lambda x: x["name"]))
    return F.transform(names, lambda n: F.element_at(F.filter(both, lambda x: x["name"] == n), -1))


def scrub_counts(runtime: Column) -> Column:
    count = lambda p: F.regexp_count(runtime, F.lit(p)).cast("long")
    return F.struct(count(OBJECT_REPR).alias("objects"), count(TORCH_SIZE).alias("sizes"), count("defaultdict\\(").alias("defaultdicts"))


def pairs_of(text: Column, pattern: str) -> Column:
    """All matches of a pattern with two groups, as (first, second)."""
    one = lambda g: F.regexp_extract_all(text, F.lit(pattern), F.lit(g))
    return F.arrays_zip(one(1).alias("first"), one(2).alias("second"))


def clean_type(raw: Column) -> Column:
    """A class name out of its representation; null if nothing usable is left."""
    text = F.regexp_replace(raw, "^\\s+|\\s+$", "")
    wrapped = F.startswith(text, F.lit("<class '")) & F.endswith(text, F.lit("'>"))
    inner = F.when(wrapped, F.regexp_extract(text, "(?s)^<class '(.*)'>$", 1)).otherwise(text)
    return F.when((inner != "") & ~F.startswith(inner, F.lit("<")) & ~F.endswith(inner, F.lit(">")), inner)


def spec_text(spec: Column) -> Column:
    """shape=(..), dtype=.. of an element specification; empty without either."""
    part = lambda p, form: F.when(F.regexp_extract(spec, p, 1) != "", F.format_string(form, F.regexp_extract(spec, p, 1)))
    return F.coalesce(F.concat_ws(", ", part("shape=\\(([^)]*)\\)", "shape=(%s)"), part("dtype=([\\w.]+)", "dtype=%s")), F.lit(""))


def numbered_cells(codes: Column) -> Column:
    """Cells in order under numbered headings."""
    return F.array_join(F.transform(codes, lambda c, i: F.concat(F.lit(CELL), (i + 1).cast("string"), F.lit(":\n"), c, F.lit("\n\n"))), "")


def json_or_raw(text: Column, schema: str) -> Column:
    """(parsed, raw): a JSON object by schema, or the text where it is none."""
    parsed = F.from_json(text, schema, {"mode": "PERMISSIVE"})
    is_object = F.get_json_object(text, "$").isNotNull() & F.startswith(F.ltrim(text), F.lit("{"))
    return F.struct(F.when(is_object, parsed).alias("parsed"), F.when(~F.coalesce(is_object, F.lit(False)), text).alias("raw"))


def retry_seconds(message: Column) -> Column:
    """Seconds of a delay given as 20ms, 1.5s or 2m."""
    number = F.regexp_extract(message, "(\\d+(?:\\.\\d+)?)\\s*(ms|s|m)\\b", 1).try_cast("double")
    unit = F.regexp_extract(message, "(\\d+(?:\\.\\d+)?)\\s*(ms|s|m)\\b", 2)
    return F.when(unit == "ms", number / 1000).when(unit == "m", number * 60).when(unit == "s", number)


def import_aliases(code: Column) -> Column:
    """(module, alias) for each module that a type annotation can name after the code's import lines.

    `import a.b as c` binds a.b to c, `import a.b` binds itself; both make the
    root a usable too. Later aliases of one module win, a plain import never
    replaces an alias of a root. `from` imports bind nothing here.
    """
    lines = F.transform(F.split(code, "\n", -1), lambda x: F.regexp_replace(x, "^\\s+|\\s+$", ""))
    aliased, plain = "^import\\s+(\\w+(?:\\.\\w+)*)\\s+as\\s+(\\w+)", "^import\\s+(\\w+(?:\\.\\w+)*)"
    entry = lambda m, a, weak: F.struct(m.alias("module"), a.alias("alias"), F.lit(weak).alias("weak"))

    def of(line: Column) -> Column:
        name = F.regexp_extract(line, plain, 1)
        root = F.substring_index(name, ".", 1)
        bound = F.when(line.rlike(aliased), entry(name, F.regexp_extract(line, aliased, 2), False)).otherwise(F.when(F.instr(name, ".") > 0, entry(name, name, False)).otherwise(entry(name, name, True)))
        return F.array(bound, entry(root, root, True))

    found = F.flatten(F.transform(F.filter(lines, lambda x: x.rlike(plain)), of))
    # A strong entry replaces what is there; a weak one only fills a gap.
    step = lambda acc, x: F.when(x["weak"] & F.exists(acc, lambda y: y["module"] == x["module"]), acc).otherwise(F.array_append(F.filter(acc, lambda y: y["module"] != x["module"]), F.struct(x["module"].alias("module"), x["alias"].alias("alias"))))
    return F.aggregate(found, F.array().cast("array<struct<module:string,alias:string>>"), step)
