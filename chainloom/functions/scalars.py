"""Scalar and aggregate functions that Spark names or answers otherwise, as Spark SQL text.

`rewrite` takes a function's lower-case name (list_x as array_x) and its arguments as Spark SQL, each one a single token or in
brackets, and gives an expression, or None where Spark's own function (perhaps of another name, see RENAMED) does.
"""

from __future__ import annotations

import re

from ..errors import SyntaxRejected

#: Functions that only have another name in Spark.
RENAMED = {
    "strpos": "instr", "starts_with": "startswith", "ends_with": "endswith", "random": "rand", "approx_distinct": "approx_count_distinct", "substr_index": "substring_index",
    "to_timestamp_seconds": "timestamp_seconds", "to_timestamp_millis": "timestamp_millis", "to_timestamp_micros": "timestamp_micros", "to_unixtime": "unix_timestamp",
    "to_char": "date_format", "array_remove_all": "array_remove", "array_to_string": "array_join", "array_length": "cardinality",
    "array_concat": "concat", "array_cat": "concat", "array_reverse": "reverse", "array_push_back": "array_append", "make_array": "array", "make_map": "map", "unnest": "explode",
    "var": "var_samp", "var_sample": "var_samp", "var_population": "var_pop", "covar": "covar_samp", "datepart": "date_part", "datetrunc": "date_trunc",
    "array_element": "try_element_at", "array_extract": "try_element_at",
}


def _args(template: str):
    return lambda a: template.format(*a)


def _has(a: list[str]) -> str:
    if "null" in (a[0].lower(), a[1].lower()):
        return "CAST(NULL AS BOOLEAN)"
    return f"(CASE WHEN {a[0]} IS NULL OR {a[1]} IS NULL THEN NULL ELSE coalesce(array_contains({a[0]}, {a[1]}), false) END)"


def _gcd(a: str, b: str) -> str:
    step = "aggregate(sequence(1, 100), named_struct('a', abs(CAST({0} AS BIGINT)), 'b', abs(CAST({1} AS BIGINT))), (s, i) -> if(s.b = 0, s, named_struct('a', s.b, 'b', s.a % s.b)), s -> s.a)"
    return step.format(a, b)


def _date_bin(width: str, at: str, origin: str = "TIMESTAMP_NTZ '1970-01-01 00:00:00'") -> str:
    """The start of the bin of `width` (microseconds to days, or months and years) that a timestamp lies in."""
    if re.search(r"month|year", width, re.I):
        whole = f"CAST({width} AS INTERVAL YEAR TO MONTH)"
        months = f"(extract(YEAR FROM {whole}) * 12 + extract(MONTH FROM {whole}))"
        apart = f"((year({at}) - year({origin})) * 12 + month({at}) - month({origin}))"
        full = f"({apart} - if({origin} + make_ym_interval(0, {apart}) > {at}, 1, 0))"
        return f"({origin} + make_ym_interval(0, CAST(floor({full} / CAST({months} AS DOUBLE)) AS INT) * {months}))"
    whole = f"CAST({width} AS INTERVAL DAY TO SECOND)"
    micros = f"((extract(DAY FROM {whole}) * 86400L + extract(HOUR FROM {whole}) * 3600L + extract(MINUTE FROM {whole}) * 60L) * 1000000L + CAST(extract(SECOND FROM {whole}) * 1000000 AS BIGINT))"
    start, now = (f"unix_micros(CAST({x} AS TIMESTAMP_LTZ))" for x in (origin, at))
    return f"CAST(timestamp_micros({now} - pmod({now} - {start}, {micros})) AS TIMESTAMP_NTZ)"


#: An escaped character or a class, which open no group, or what opens one.
_GROUP = re.compile(r"\\.|\[(?:\\.|[^\]])*\]|(\((?!\?)|\(\?P?<(?![=!]))")


def _regexp_match(a: list[str]) -> str:
    """The groups of the first match, or the match if the pattern has none; NULL without a match."""
    if not re.fullmatch(r"'(?:[^']|'')*'", a[1]):
        raise SyntaxRejected("regexp_match needs a pattern that is written out")
    p = f"concat('(?{a[2].strip('() ')[1:-1]})', {a[1]})" if len(a) > 2 else a[1]
    groups = sum(bool(x) for x in _GROUP.findall(a[1][1:-1].replace("\\\\", "\\")))
    found = ", ".join(f"regexp_extract({a[0]}, {p}, {i})" for i in (range(1, groups + 1) if groups else (0,)))
    return f"(CASE WHEN regexp_like({a[0]}, {p}) THEN array({found}) END)"


def slice_of(a: str, first: str, last: str) -> str:
    """Elements first to last, both counted from 1, or from the end if negative."""

    def place(i: str) -> str:
        return f"CAST(if({i} < 0, size({a}) + {i} + 1, {i}) AS INT)"

    start = f"greatest({place(first)}, 1)"
    return f"slice({a}, {start}, greatest({place(last)} - {start} + 1, 0))"


def _places(a: str, x: str, n: str) -> str:
    """Places (from 0) of the first n elements equal to x."""
    return f"slice(filter(transform({a}, (e, i) -> if(e <=> {x}, i, CAST(NULL AS INT))), p -> p IS NOT NULL), 1, {n})"


def _remove(a: str, x: str, n: str = "1") -> str:
    return f"filter({a}, (e, i) -> NOT array_contains({_places(a, x, n)}, i))"


def _replace(a: str, x: str, y: str, n: str = "1") -> str:
    return f"transform({a}, (e, i) -> if(array_contains({_places(a, x, n)}, i), {y}, e))"


def _sorted(a: list[str]) -> str:
    words = [x.strip("'").upper() for x in a[1:]]
    nulls, rest = f"filter({a[0]}, e -> e IS NULL)", f"filter(sort_array({a[0]}, {'false' if words[:1] == ['DESC'] else 'true'}), e -> e IS NOT NULL)"
    return f"concat({rest}, {nulls})" if words[1:] == ["NULLS LAST"] else f"concat({nulls}, {rest})"


def _is_array(x: str) -> bool:
    """Whether an argument is plainly an array: the column topics, a literal, or what an array function gives."""
    return x.split(".")[-1].strip('"') == "topics" or x.lstrip("(").startswith(("array", "slice(", "filter(", "transform(", "sequence(", "map_keys", "map_values"))


def _concat(a: list[str]) -> str | None:
    """Text: NULLs count as empty. Arrays stay with Spark's concat."""
    if any(map(_is_array, a)):
        return None
    return f"concat({', '.join(f'''coalesce(CAST({x} AS STRING), '')''' for x in a)})"


def _regexp_replace(a: list[str]) -> str:
    """The first match, or with the flag g all."""
    flags = a[3].strip("'") if len(a) > 3 else ""
    mode = "".join(c for c in flags if c in "ism")
    s, p, r = a[0], f"concat('(?{mode})', {a[1]})" if mode else a[1], re.sub(r"\\\\(\d)", r"$\1", a[2])
    if "g" in flags:
        return f"regexp_replace({s}, {p}, {r})"
    found = f"regexp_substr({s}, {p})"
    at = f"regexp_instr({s}, {p})"
    return f"(CASE WHEN {at} = 0 THEN {s} ELSE concat(substring({s}, 1, {at} - 1), regexp_replace({found}, {p}, {r}), substring({s}, {at} + length({found}))) END)"


def _flagged(template: str):
    def made(a: list[str]) -> str:
        mode = "".join(c for c in a[-1].strip("'") if c in "ism")
        return template.format(*a[:-1], p=f"concat('(?{mode})', {a[1]})" if mode else a[1])

    return made


#: Letters of strftime patterns in Spark's patterns.
_STRFTIME = {"Y": "yyyy", "y": "yy", "m": "MM", "d": "dd", "e": "d", "H": "HH", "I": "hh", "M": "mm", "S": "ss", "f": "SSSSSSSSS", "p": "a", "j": "DDD", "b": "MMM", "h": "MMM", "B": "MMMM", "a": "EEE", "A": "EEEE", "F": "yyyy-MM-dd", "T": "HH:mm:ss", "R": "HH:mm", "D": "MM/dd/yy", "%": "%"}


def pattern(literal: str) -> str:
    """A quoted strftime pattern as one of Spark's; others stay."""
    if not literal.startswith("'") or "%" not in literal:
        return literal
    out = []
    for m in re.finditer(r"%(.)|([A-Za-z]+)|(.)", literal[1:-1], re.S):
        if m[1]:
            if m[1] not in _STRFTIME:
                raise SyntaxRejected(f"date pattern %{m[1]}")
            out.append(_STRFTIME[m[1]])
        else:
            out.append(f"''{m[2]}''" if m[2] else m[3])
    return f"'{''.join(out)}'"


def _dated(name: str):
    return lambda a: f"{name}({a[0]}, {pattern(a[1])})"


def _date_part(a: list[str]) -> str:
    part, x = a[0].strip("'").lower(), a[1]
    found = {
        "dow": f"((weekday({x}) + 1) % 7)", "isodow": f"(weekday({x}) + 1)", "epoch": f"(unix_micros(CAST({x} AS TIMESTAMP_LTZ)) / 1000000D)", "second": f"CAST(extract(SECOND FROM {x}) AS INT)",
        "millisecond": f"CAST(extract(SECOND FROM {x}) * 1000 AS INT)", "microsecond": f"CAST(extract(SECOND FROM {x}) * 1000000 AS INT)", "nanosecond": f"CAST(extract(SECOND FROM {x}) * 1000000000 AS BIGINT)",
    }
    return found.get(part) or found.get(part.rstrip("s")) or f"date_part({a[0]}, {x})"


#: Arrow's types in Spark's.
_ARROW = {
    "Int8": "TINYINT", "Int16": "SMALLINT", "Int32": "INT", "Int64": "BIGINT", "UInt8": "SMALLINT", "UInt16": "INT", "UInt32": "BIGINT", "UInt64": "DECIMAL(20, 0)", "Float32": "FLOAT", "Float64": "DOUBLE",
    "Utf8": "STRING", "LargeUtf8": "STRING", "Utf8View": "STRING", "Boolean": "BOOLEAN", "Date32": "DATE", "Date64": "DATE", "Binary": "BINARY", "LargeBinary": "BINARY",
}
_UNITS = {"Second": 1, "Millisecond": 1000, "Microsecond": 1_000_000, "Nanosecond": 1_000_000_000}


def _arrow_cast(a: list[str]) -> str:
    kind = a[1].strip("'")
    if kind in _ARROW:
        return f"CAST({a[0]} AS {_ARROW[kind]})"
    if m := re.fullmatch(r"Decimal(?:128|256)\((\d+), *(-?\d+)\)", kind):
        return f"CAST({a[0]} AS DECIMAL({m[1]}, {m[2]}))"
    if m := re.fullmatch(r"Duration\((\w+)\)", kind):
        return f"make_dt_interval(0, 0, 0, CAST({a[0]} AS DECIMAL(38, 9)) / {_UNITS[m[1]]})"
    if kind.startswith("Timestamp("):
        return f"CAST({a[0]} AS TIMESTAMP_NTZ)"
    raise SyntaxRejected(f"arrow_cast to {kind}")


def _arrow_typeof(a: list[str]) -> str:
    names = {"bigint": "Int64", "int": "Int64", "smallint": "Int16", "tinyint": "Int8", "double": "Float64", "float": "Float32", "string": "Utf8", "boolean": "Boolean", "date": "Date32", "timestamp_ntz": "Timestamp(Nanosecond, None)", "binary": "Binary", "void": "Null", "decimal(20,0)": "UInt64"}
    cases = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in names.items())
    return f"(CASE typeof({a[0]}) {cases} ELSE regexp_replace(typeof({a[0]}), '^decimal\\\\((\\\\d+),(\\\\d+)\\\\)$', 'Decimal128($1, $2)') END)"


def _digest(a: list[str]) -> str:
    kind = a[1].strip("'").lower()
    if kind not in ("md5", "sha224", "sha256", "sha384", "sha512"):
        raise SyntaxRejected(f"digest {kind!r} is not supported")
    return f"unhex(md5({a[0]}))" if kind == "md5" else f"unhex(sha2({a[0]}, {kind[3:]}))"


def _coded(hexed: str, based: str):
    def made(a: list[str]) -> str | None:
        kind = a[1].strip("'").lower()
        return hexed.format(a[0]) if kind == "hex" else based.format(a[0]) if kind == "base64" else None

    return made


#: Functions that become expressions, by name and number of arguments.
EXPRESSIONS = {
    # text
    ("to_hex", 1): _args("lower(hex({0}))"), ("left", 2): _args("(CASE WHEN {1} < 0 THEN substring({0}, 1, length({0}) + {1}) ELSE left({0}, {1}) END)"), ("right", 2): _args("(CASE WHEN {1} < 0 THEN substring({0}, 1 - {1}) ELSE right({0}, {1}) END)"),
    ("repeat", 2): _args("(CASE WHEN {1} IS NULL THEN NULL ELSE repeat({0}, CAST(least(greatest({1}, 0), 2147483647) AS INT)) END)"), ("ltrim", 2): _args("trim(LEADING {1} FROM {0})"), ("rtrim", 2): _args("trim(TRAILING {1} FROM {0})"), ("trim", 2): _args("trim(BOTH {1} FROM {0})"),
    ("regexp_replace", 3): _regexp_replace, ("regexp_replace", 4): _regexp_replace, ("regexp_like", 3): _flagged("regexp_like({0}, {p})"), ("regexp_match", 2): _regexp_match, ("regexp_match", 3): _regexp_match,
    ("encode", 2): _coded("lower(hex({0}))", "trim(TRAILING '=' FROM base64({0}))"), ("decode", 2): _coded("unhex({0})", "unbase64({0})"), ("digest", 2): _digest,
    ("sha224", 1): _args("unhex(sha2({0}, 224))"), ("sha256", 1): _args("unhex(sha2({0}, 256))"), ("sha384", 1): _args("unhex(sha2({0}, 384))"), ("sha512", 1): _args("unhex(sha2({0}, 512))"),
    # numbers
    ("ceil", 1): _args("CAST(ceil({0}) AS DOUBLE)"), ("floor", 1): _args("CAST(floor({0}) AS DOUBLE)"), ("iszero", 1): _args("({0} = 0)"), ("log", 1): _args("log10({0})"), ("gcd", 2): lambda a: _gcd(*a), ("lcm", 2): lambda a: f"(CASE WHEN {a[0]} = 0 OR {a[1]} = 0 THEN 0 ELSE abs({a[0]} div {_gcd(*a)} * {a[1]}) END)",
    ("trunc", 1): _args("(sign({0}) * floor(abs({0})))"), ("trunc", 2): _args("(sign({0}) * floor(abs({0}) * power(10, {1})) / power(10, {1}))"),
    ("approx_median", 1): lambda a: percentile_of(a[0], "0.5D"), ("approx_percentile_cont", 2): lambda a: percentile_of(*a), ("approx_percentile_cont", 3): lambda a: percentile_of(*a[:2]), ("approx_percentile_cont_with_weight", 3): _args("percentile({0}, {2}, {1})"),
    # dates
    ("date_bin", 2): lambda a: _date_bin(*a), ("date_bin", 3): lambda a: _date_bin(*a), ("date_part", 2): _date_part, ("datepart", 2): _date_part, ("to_timestamp_nanos", 1): _args("timestamp_micros({0} div 1000)"), ("to_local_time", 1): _args("CAST({0} AS TIMESTAMP_NTZ)"),
    ("to_char", 2): _dated("date_format"), ("date_format", 2): _dated("date_format"), ("to_date", 2): _dated("to_date"), ("to_timestamp", 2): _dated("to_timestamp"),
    # arrays
    ("array_has", 2): _has, ("array_contains", 2): _has, ("array_has_all", 2): _args("(size(array_except({1}, {0})) = 0)"), ("array_has_any", 2): _args("(size(array_intersect({0}, {1})) > 0)"), ("arrays_overlap", 2): _args("(size(array_intersect({0}, {1})) > 0)"),
    ("array_slice", 3): lambda a: slice_of(*a), ("array_pop_back", 1): _args("slice({0}, 1, greatest(size({0}) - 1, 0))"), ("array_pop_front", 1): _args("slice({0}, 2, size({0}))"), ("string_to_array", 2): _args("split({0}, concat('\\\\Q', {1}, '\\\\E'))"),
    ("array_prepend", 2): _args("array_prepend({1}, {0})"), ("array_push_front", 2): _args("array_prepend({1}, {0})"), ("array_position", 2): _args("nullif(array_position({0}, {1}), 0)"), ("array_positions", 2): _args("filter(transform({0}, (e, i) -> if(e <=> {1}, i + 1, NULL)), p -> p IS NOT NULL)"),
    ("array_remove", 2): lambda a: _remove(*a), ("array_remove_n", 3): lambda a: _remove(*a), ("array_replace", 3): lambda a: _replace(*a), ("array_replace_n", 4): lambda a: _replace(*a), ("array_replace_all", 3): _args("transform({0}, e -> if(e <=> {1}, {2}, e))"),
    ("array_sort", 1): _sorted, ("array_sort", 2): _sorted, ("array_sort", 3): _sorted, ("array_resize", 2): _args("concat(slice({0}, 1, {1}), array_repeat(NULL, greatest({1} - size({0}), 0)))"), ("array_resize", 3): _args("concat(slice({0}, 1, {1}), array_repeat({2}, greatest({1} - size({0}), 0)))"),
    ("array_ndims", 1): _args("(length(regexp_extract(typeof({0}), '^((?:array<)*)', 1)) div 6)"), ("array_empty", 1): _args("(size({0}) = 0)"), ("empty", 1): _args("(size({0}) = 0)"), ("array_any_value", 1): _args("try_element_at(filter({0}, e -> e IS NOT NULL), 1)"),
    ("array_distance", 2): _args("sqrt(aggregate(zip_with({0}, {1}, (a, b) -> power(a - b, 2)), CAST(0 AS DOUBLE), (s, v) -> s + v))"), ("array_agg", 1): _args("(CASE WHEN count(1) > 0 THEN transform(collect_list(named_struct('v', {0})), e -> e.v) END)"),
    ("generate_series", 2): _args("sequence({0}, {1})"), ("generate_series", 3): _args("sequence({0}, {1}, {2})"), ("range", 2): _args("(CASE WHEN {0} < {1} THEN sequence({0}, {1} - 1) ELSE array() END)"),
    # structs, maps, types
    ("get_field", 2): _args("{0}[{1}]"), ("map", 2): lambda a: f"map_from_arrays({a[0]}, {a[1]})" if _is_array(a[0]) else None, ("map_extract", 2): _args("array(try_element_at({0}, {1}))"), ("arrow_typeof", 1): _arrow_typeof, ("arrow_cast", 2): _arrow_cast,
}


def _substr(a: list[str]) -> str | None:
    """Places before the first count, but hold nothing."""
    if a[1].isdigit() and int(a[1]):
        return None
    if len(a) == 2:
        return f"(CASE WHEN {a[1]} < 1 THEN {a[0]} ELSE substring({a[0]}, {a[1]}) END)"
    return f"(CASE WHEN {a[1]} < 1 THEN substring({a[0]}, 1, {a[1]} + {a[2]} - 1) ELSE substring({a[0]}, {a[1]}, {a[2]}) END)"


def rewrite(name: str, args: list[str]) -> str | None:
    if name in ("substr", "substring") and len(args) in (2, 3):
        return _substr(args)
    if name == "concat" and args:
        return _concat(args)
    made = EXPRESSIONS.get((name, len(args)))
    return made(args) if made else None


def percentile_of(x: str, p: str) -> str:
    """Exact, since a sketch's error grows with the rows. By its weight of 1L, `division.run` knows that it is of x's type."""
    return f"percentile({x}, {p}, 1L)"


def sketched(name: str, args: list[str]) -> str | None:
    """An approximate percentile as one call, which FILTER or OVER may follow."""
    if (name, len(args)) == ("approx_median", 1):
        return f"percentile_approx({args[0]}, 0.5)"
    return f"percentile_approx({', '.join(args)})" if name == "approx_percentile_cont" and len(args) in (2, 3) else None


def _percentile(key: str, a: list[str], down: bool) -> str:
    return percentile_of(key, f"1 - {a[0]}" if down else a[0])


#: f(arguments) WITHIN GROUP (ORDER BY key).
WITHIN_GROUP = {
    "approx_percentile_cont": _percentile,
    "approx_percentile_cont_with_weight": lambda key, a, down: f"percentile({key}, {f'1 - {a[1]}' if down else a[1]}, {a[0]})",
}
