"""Functions that need Python's own parser or tokenizer: Arrow-batched pandas UDFs."""

from __future__ import annotations

import ast
import io
import tokenize

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from verdigris.functions.text import found_types, scrubbed


def strip_comments(code: str | None) -> str | None:
    """The code without comments, each line without blanks at its end; None stays None, and what cannot be tokenised stays as it is.

    The tokenizer counts newlines alone; afterwards lines end at whatever Python
    ends lines at (form feeds, U+2028).
    """
    if code is None:
        return None
    lines = code.split("\n")
    try:
        for token in tokenize.generate_tokens(io.StringIO(code).readline):
            if token.type == tokenize.COMMENT:
                row, col = token.start
                lines[row - 1] = lines[row - 1][:col]
    except (tokenize.TokenError, SyntaxError):
        return code
    return "\n".join(x.rstrip() for x in "\n".join(lines).splitlines())


def _parsed(code: str | None) -> ast.Module | None:
    try:
        return ast.parse(code or "")
    except (SyntaxError, ValueError):
        return None


def functions_in(code: str | None) -> list[dict]:
    tree = _parsed(code)
    return [{"name": n.name, "source": strip_comments(ast.get_source_segment(code, n))} for n in ast.walk(tree) if isinstance(n, ast.FunctionDef)] if tree else []


def definitions_in(code: str | None) -> list[dict]:
    """Names bound by plain assignments, annotated ones, functions and classes, nested ones too, by line."""
    tree, out = _parsed(code), []
    for node in ast.walk(tree) if tree else ():
        if isinstance(node, ast.FunctionDef | ast.AsyncFunctionDef | ast.ClassDef):
            out.append((node.lineno, node.col_offset, node.name))
        targets = node.targets if isinstance(node, ast.Assign) else [node.target] if isinstance(node, ast.AnnAssign) else []
        out += [(node.lineno, t.col_offset, t.id) for t in targets if isinstance(t, ast.Name)]
    return [{"name": name, "lineno": line} for line, _, name in sorted(out)]


def dependencies_in(code: str | None) -> dict:
    """Names read, (base, attribute) pairs and the bases of subscripts outside the bodies of functions and classes. Coroutines and lambdas are looked into."""
    names, pairs, bases, todo = set(), set(), set(), [_parsed(code)]
    while todo:
        node = todo.pop()
        if node is None or isinstance(node, ast.FunctionDef | ast.ClassDef):
            continue
        if isinstance(node, ast.Name) and isinstance(node.ctx, ast.Load):
            names.add(node.id)
        elif isinstance(node, ast.Attribute):
            pairs.add((ast.unparse(node.value), node.attr))
        elif isinstance(node, ast.Subscript):
            bases.add(ast.unparse(node.value))
        todo += ast.iter_child_nodes(node)
    return {"names": sorted(names), "attributes": [{"base": b, "attr": a} for b, a in sorted(pairs)], "subscripts": sorted(bases)}


def literal_types(text: str | None) -> list[dict] | None:
    """(name, type) of a literal dictionary of variables; None for a text that is no literal."""
    try:
        found = ast.literal_eval((text or "").strip())
    except (SyntaxError, ValueError, MemoryError, RecursionError):
        return None
    return [{"name": str(k), "type": str(v.get("type", "Any"))} for k, v in found.items() if isinstance(v, dict)] if isinstance(found, dict) else []


def _udf(function, kind: str):
    result = T._parse_datatype_string(kind)

    @F.pandas_udf(result)
    def apply(codes: pd.Series) -> pd.Series:
        return codes.map(function, na_action=None)

    @F.pandas_udf(result)
    def apply_struct(codes: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([function(c) for c in codes], columns=[f.name for f in result.fields])

    return lambda column: (apply_struct if isinstance(result, T.StructType) else apply)(column)


def without_comments(code):
    return _udf(strip_comments, "string")(code)


def function_sources(code):
    return _udf(functions_in, "array<struct<name:string,source:string>>")(code)


def definitions(code):
    return _udf(definitions_in, "array<struct<name:string,lineno:int>>")(code)


def dependencies(code):
    return _udf(dependencies_in, "struct<names:array<string>,attributes:array<struct<base:string,attr:string>>,subscripts:array<string>>")(code)


def typed_names(runtime):
    """(name, type) of runtime information: of the literal it makes once unreadable representations are replaced, or else what patterns find in it."""
    clean = scrubbed(runtime)
    return F.coalesce(_udf(literal_types, "array<struct<name:string,type:string>>")(clean), found_types(clean))
