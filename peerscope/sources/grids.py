"""Untyped CSV grids: reading, header detection, column mapping, layout unification."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from peerscope.functions.text import clean_text, normalize_header
from peerscope.session import materialize

HEADER_SCAN_ROWS = 15
CELL = r',("(?:[^"]++|"")*+"|[^,]*+)'
#: A cell that is not left open, behind its comma.
COMPLETE_CELL = r',(?:"(?:[^"]++|"")*+"[^,]*+|[^,"][^,]*+|(?=,|$))'
BYTE_ORDER_MARK = "\u00ef\u00bb\u00bf"  # UTF-8's, as three characters of one byte


def _unquoted(cell: Column) -> Column:
    inner = F.replace(F.substr(cell, F.lit(2), F.length(cell) - 2), F.lit('""'), F.lit('"'))
    return F.when(F.startswith(cell, F.lit('"')) & (F.length(cell) > 1), inner).otherwise(cell)


def _windows_1252(text: Column) -> Column:
    """Latin-1 text with the printable characters Windows puts in place of the C1 controls."""
    pairs = []
    for code in range(0x80, 0xA0):
        try:
            pairs.append((chr(code), bytes([code]).decode("cp1252")))
        except UnicodeDecodeError:  # five codes are unassigned
            continue
    return F.translate(text, "".join(a for a, _ in pairs), "".join(b for _, b in pairs))


def _reopened(cells: Column) -> Column:
    """Whether cells, each behind a comma, end inside of a quoted one."""
    return F.regexp_replace(cells, COMPLETE_CELL, "") != ""


def _lines(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """(path, block, id, line, starts) of text files in any number of tasks; id ascends in a block of a file, blocks by their place.

    ``starts`` says that a line begins a record, as no quoted cell is open there. What a line does to that state depends on its own text
    alone: most keep it, the others settle it (whatever it was before) or turn it round. So the state before a line is the last
    settled one, turned as often as lines did since; both are running values, over the lines of a block and over the blocks of a file.
    """
    raw = spark.read.text(list(paths), lineSep="\n").select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.decode(F.col("value").cast("binary"), "ISO-8859-1").alias("line")
    )
    # from outside and from inside of a quoted cell: is one open at the line's end?
    closed = F.rlike("line", F.lit('^(?:[^"]++|"")*+"'))
    from_inside = ~closed | _reopened(F.regexp_replace("line", '^(?:[^"]++|"")*+"[^,]*+', ""))
    quoted = F.contains("line", F.lit('"'))
    raw = raw.withColumn("_out", quoted & _reopened(F.concat(F.lit(","), "line"))).withColumn("_in", ~quoted | from_inside)
    lines = materialize(raw.withColumn("id", F.monotonically_increasing_id()))
    settles, turns = F.col("_out") == F.col("_in"), (F.col("_out") & ~F.col("_in")).cast("long")
    in_block = Window.partitionBy("path", "block").orderBy("id").rowsBetween(Window.unboundedPreceding, 0)
    # a settled state is kept with the turns up to there, so that it can be read after any number of further turns
    local = lines.withColumn("_turns", F.sum(turns).over(in_block))
    local = local.withColumn("_state", F.last(F.when(settles, F.col("_out").cast("long") + F.col("_turns")), ignorenulls=True).over(in_block))
    blocks = local.groupBy("path", "block").agg(F.max("_turns").alias("_all"), F.max_by("_state", "id").alias("_last"))
    of_file = Window.partitionBy("path").orderBy("block")
    before = of_file.rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("_turned", F.coalesce(F.sum("_all").over(before), F.lit(0)))
    blocks = blocks.withColumn("_known", F.coalesce(F.last(F.col("_last") + F.col("_turned"), ignorenulls=True).over(before), F.lit(0)))
    after = (F.coalesce(F.col("_state") + F.col("_turned"), F.col("_known")) + F.col("_turns") + F.col("_turned")) % 2
    opened = F.lag("_after").over(Window.partitionBy("path", "block").orderBy("id"))
    at_block = (F.col("_known") + F.col("_turned")) % 2
    found = local.join(blocks.select("path", "block", "_turned", "_known"), ["path", "block"]).withColumn("_after", after)
    return found.withColumn("starts", F.coalesce(opened, at_block) == 0).select("path", "block", "id", "line", "starts")


def _records(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """(path, block, id, record): lines joined where a quoted cell runs over their end; block and id are the first line's."""
    lines = _lines(spark, paths)
    own = F.when(F.col("starts"), F.struct("block", "id"))
    in_block = Window.partitionBy("path", "block").orderBy("id").rowsBetween(Window.unboundedPreceding, 0)
    lines = lines.withColumn("_first", F.last(own, ignorenulls=True).over(in_block)).withColumn("_next", F.lead("starts").over(Window.partitionBy("path", "block").orderBy("id")))
    # a line between two starts is a record; only the others, and those beside a block's edge, are put together
    alone = F.col("starts") & F.coalesce("_next", F.lit(False))
    lines = materialize(lines.withColumn("_alone", alone))
    parts = lines.filter("not _alone")
    edges = parts.groupBy("path", "block").agg(F.max("_first").alias("_last"))
    edges = edges.withColumn("_open", F.last("_last", ignorenulls=True).over(Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)))
    parts = parts.join(edges.select("path", "block", "_open"), ["path", "block"]).withColumn("_first", F.coalesce("_first", "_open"))
    line = F.struct("block", "id", "line")
    put = parts.groupBy("path", "_first").agg(F.array_join(F.transform(F.array_sort(F.collect_list(line)), lambda x: x["line"]), "\n").alias("record"))
    return lines.filter("_alone").select("path", "block", "id", F.col("line").alias("record")).unionAll(put.select("path", "_first.block", "_first.id", "record"))


def read_grids(spark: SparkSession, paths: Sequence[str], sheets_in_folders: bool = False) -> DataFrame:
    """(source, sheet, row_no, cells) of CSV files; blank rows are skipped and not numbered.

    Every cell is text and empty cells are NULL; trailing ones are left out. A record of any width keeps
    all its cells. A file is UTF-8 unless one of its records is not valid UTF-8, then it has one byte per character. With
    ``sheets_in_folders`` the folder is the source and its files are sheets. A quoted cell may span
    lines; a file of any size is read in blocks by many tasks all the same, and rows are numbered from 0 in file order.
    """
    raw = _records(spark, paths).withColumn("record", F.regexp_replace("record", "\r$", ""))  # of lines that end in two characters
    rows = raw.withColumn("broken", ~F.is_valid_utf8(F.encode("record", "ISO-8859-1").cast("string")))
    rows = rows.withColumn("_cells", F.transform(F.regexp_extract_all(F.concat(F.lit(","), "record"), F.lit(CELL), F.lit(1)), _unquoted))
    last = F.array_max(F.transform("_cells", lambda c, i: F.when(F.translate(c, BYTE_ORDER_MARK, "") != "", i + 1)))
    rows = materialize(rows.drop("record").withColumn("_last", last).filter("_last is not null"))
    blocks = rows.groupBy("path", "block").agg(F.count("*").alias("_n"), F.max("broken").alias("_broken"))
    of_file = Window.partitionBy("path").orderBy("block")
    blocks = blocks.withColumn("_before", F.coalesce(F.sum("_n").over(of_file.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("_one_byte", F.max("_broken").over(Window.partitionBy("path")))
    number = F.row_number().over(Window.partitionBy("path", "block").orderBy("id")) - 1 + F.col("_before")
    rows = rows.join(blocks.select("path", "block", "_before", "_one_byte"), ["path", "block"]).withColumn("row_no", number.cast("long"))
    text = F.transform(F.slice("_cells", F.lit(1), F.col("_last")), lambda c: F.when(F.col("_one_byte"), _windows_1252(c)).otherwise(F.encode(c, "ISO-8859-1").cast("string")))
    rows = rows.withColumn("cells", F.transform(text, lambda c: F.nullif(F.translate(c, "\ufeff", ""), F.lit(""))))
    name = F.element_at(F.split("path", "/"), -1)
    folder = F.element_at(F.split("path", "/"), -2)
    decoded = F.url_decode(F.replace(folder if sheets_in_folders else name, F.lit("+"), F.lit("%2B")))
    return rows.select(decoded.alias("source"), F.url_decode(F.replace(name, F.lit("+"), F.lit("%2B"))).alias("sheet"), "row_no", "cells")


def alias_table(spark: SparkSession, aliases: Mapping[str, Sequence[str]]) -> DataFrame:
    """(canonical, variant, rank): the names a field may carry, preferred first. Written by hand, small."""
    rows = [(canonical, variant, rank) for canonical, variants in aliases.items() for rank, variant in enumerate(variants)]
    table = spark.createDataFrame(rows, "canonical string, variant string, rank int")
    return table.withColumn("variant", normalize_header(F.col("variant")))


def _alias_hits(rows: DataFrame, table: DataFrame, keys: Sequence[str]) -> DataFrame:
    cells = rows.select(*keys, F.posexplode("cells").alias("position", "cell")).filter("cell is not null")
    return cells.withColumn("variant", normalize_header(F.col("cell"))).join(table, "variant")


def detect_headers(grids: DataFrame, table: DataFrame) -> DataFrame:
    """(source, sheet, header_row, score, names): the early row naming most known fields, first on ties.

    Of several sheets the one with the best header is kept. Names are unique: a blank one becomes
    unnamed_<position>, a repeated one gets a numbered suffix.
    """
    widths = grids.groupBy("source", "sheet").agg(F.max(F.size("cells")).alias("_w"))
    early = grids.filter(F.col("row_no") < HEADER_SCAN_ROWS)
    hits = _alias_hits(early, table, ["source", "sheet", "row_no"])
    scores = hits.groupBy("source", "sheet", "row_no").agg(F.count_distinct("canonical").alias("score"))
    scored = early.join(scores, ["source", "sheet", "row_no"], "left").fillna(0, ["score"])
    best = F.struct("score", -F.col("row_no"))
    per_sheet = scored.groupBy("source", "sheet").agg(
        F.max_by(F.struct(F.col("row_no").alias("header_row"), "score", "cells"), best).alias("_h")
    )
    pick = per_sheet.groupBy("source").agg(
        F.min_by(F.struct("sheet", "_h"), F.struct(-F.col("_h.score"), F.col("sheet"))).alias("_s")
    )
    names = F.transform(
        "_c", lambda c, i: F.coalesce(clean_text(c), F.concat(F.lit("unnamed_"), i.cast("string")))
    )
    numbered = F.transform(
        "_n",
        lambda n, i: F.concat(
            n,
            F.when(
                F.array_contains(F.slice(F.col("_n"), F.lit(1), i), n),
                F.concat(F.lit("."), F.size(F.filter(F.slice(F.col("_n"), F.lit(1), i), lambda o: o == n)).cast("string")),
            ).otherwise(""),
        ),
    )
    return (
        pick.select("source", "_s.sheet", "_s._h.*")
        .join(widths, ["source", "sheet"])
        .withColumn("_c", F.transform(F.sequence(F.lit(0), F.col("_w") - 1), lambda i: F.get("cells", i)))
        .withColumn("_n", names)
        .withColumn("names", numbered)
        .select("source", "sheet", "header_row", "score", F.col("_c").alias("header"), "names")
    )


def map_columns(headers: DataFrame, table: DataFrame) -> DataFrame:
    """(source, sheet, canonical, position): first header of a name, best ranked name of a field."""
    rows = headers.select("source", "sheet", F.col("header").alias("cells"))
    hits = _alias_hits(rows, table, ["source", "sheet"])
    return hits.groupBy("source", "sheet", "canonical").agg(
        F.min_by("position", F.struct("rank", "position")).alias("position")
    )


def missing_columns(headers: DataFrame, mapping: DataFrame, required: Sequence[str]) -> DataFrame:
    """(source, sheet, canonical) for every required field a source lacks."""
    wanted = headers.select("source", "sheet", F.explode(F.array(*map(F.lit, sorted(required)))).alias("canonical"))
    return wanted.join(mapping, ["source", "sheet", "canonical"], "left_anti")


def require_columns(headers: DataFrame, mapping: DataFrame, required: Sequence[str]) -> None:
    missing = missing_columns(headers, mapping, required)
    listed = missing.join(headers.select("source", "sheet", "names"), ["source", "sheet"]).limit(20).collect()
    if listed:
        text = "; ".join(f"{r['source']}: required column {r['canonical']} not found; headers: {r['names']}" for r in listed)
        raise ValueError(text)


def records(grids: DataFrame, headers: DataFrame, mapping: DataFrame, fields: Sequence[str]) -> DataFrame:
    """Body rows as text columns named by canonical field, whatever the layout of their source.

    Also: source, data_row (from 1), raw (the row as read, by header name), found (fields the source has).
    """
    slots = mapping.groupBy("source", "sheet").agg(
        F.map_from_entries(F.collect_list(F.struct("canonical", "position"))).alias("_at")  # at most one per field
    )
    located = headers.join(slots, ["source", "sheet"], "left").select("source", "sheet", "header_row", "names", "_at")
    body = grids.join(located, ["source", "sheet"]).filter(F.col("row_no") > F.col("header_row"))

    def cell(field: str) -> Column:
        return F.get(F.col("cells"), F.try_element_at(F.col("_at"), F.lit(field)))

    padded = F.transform("names", lambda n, i: F.get(F.col("cells"), i))
    raw = F.map_from_arrays("names", padded)
    return body.select(
        "source",
        (F.col("row_no") - F.col("header_row")).alias("data_row"),
        raw.alias("raw"),
        F.coalesce(F.map_keys("_at"), F.array().cast("array<string>")).alias("found"),
        *[cell(f).alias(f) for f in fields],
    )


def read_records(
    spark: SparkSession,
    paths: Sequence[str],
    aliases: Mapping[str, Sequence[str]],
    required: Sequence[str],
    sheets_in_folders: bool = False,
) -> DataFrame:
    grids = materialize(read_grids(spark, paths, sheets_in_folders))  # parsed once, read three times
    table = alias_table(spark, aliases)
    headers = materialize(detect_headers(grids, table))
    mapping = map_columns(headers, table)
    require_columns(headers, mapping, required)
    return records(grids, headers, mapping, list(aliases))


def unify(parts: Sequence[DataFrame], fields: Sequence[str]) -> DataFrame:
    """Union of differently shaped parts on one field list; absent fields are NULL."""
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part, allowMissingColumns=True)
    for field in fields:
        if field not in result.columns:
            result = result.withColumn(field, F.lit(None).cast("string"))
    return result.select(*fields)


def profile_columns(df: DataFrame, columns: Sequence[str], top: int = 10) -> DataFrame:
    """Most frequent values per column: (column, value, count, position), NULL counted as a value."""
    long = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), clean_text(F.col(c).cast("string")).alias("value")) for c in columns])).alias("_p"))
    counted = long.groupBy("_p.column", "_p.value").agg(F.count("*").alias("count"))
    order = Window.partitionBy("column").orderBy(F.desc("count"), F.col("value").asc_nulls_first())
    return counted.withColumn("position", F.row_number().over(order)).filter(F.col("position") <= top)


def missing_share(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, missing_pct, distinct_values) in one pass over the table."""
    stats = df.agg(
        *[F.round(F.avg(F.col(c).isNull().cast("int")) * 100, 1).alias(f"m_{c}") for c in columns],
        *[F.count_distinct(c).alias(f"d_{c}") for c in columns],
    )
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"m_{c}").alias("missing_pct"), F.col(f"d_{c}").alias("distinct_values")) for c in columns])
    return stats.select(F.explode(pairs).alias("_p")).select("_p.*")


def source_profile(df: DataFrame, in_sector: Column, sector: str, organization: str, operation: str, order: str, samples: int = 2) -> DataFrame:
    """What a source holds: (section, column, value, n).

    Sections: all rows and the sector's rows and organizations; the commonest 25 sectors, and of the sector's rows the commonest 30 operation types and 10
    units of every column that names one; the per cent of missing cells; the first ``samples`` rows by ``order``. Values are
    counted in one pass over all rows, and only the leading ones of each column are ranked.
    """
    columns = [c for c in df.columns if c != order]
    units = [c for c in columns if "unit" in c.lower()]
    rows = df.withColumn("_in", F.coalesce(in_sector, F.lit(False)))
    tops = {"sectors": 25, "operation types": 30, "units": 10}
    wanted = [("sectors", sector, F.lit(True)), ("operation types", operation, F.col("_in")), *[("units", c, F.col("_in")) for c in units]]
    cells = F.array(*[F.when(given, F.struct(F.lit(section).alias("section"), F.lit(c).alias("column"), clean_text(F.col(f"`{c}`").cast("string")).alias("value"))) for section, c, given in wanted])
    counted = rows.select(F.explode(F.array_compact(cells)).alias("c")).groupBy("c.section", "c.column", "c.value").agg(F.count("*").alias("n"))
    leading = Window.partitionBy("section", "column").orderBy(F.desc("n"), F.col("value").asc_nulls_first())
    most = F.create_map(*[F.lit(x) for pair in tops.items() for x in pair])[F.col("section")]
    values = counted.withColumn("at", F.row_number().over(leading)).filter((F.col("at") <= max(tops.values())) & (F.col("at") <= most)).drop("at")

    def line(section: str, column: str | None, n: Column) -> Column:
        return F.struct(F.lit(section).alias("section"), F.lit(column).cast("string").alias("column"), F.lit(None).cast("string").alias("value"), n.cast("double").alias("n"))

    missing = [F.round(F.avg(F.when(F.col("_in"), F.col(f"`{c}`").isNull().cast("int"))) * 100, 1) for c in columns]
    totals = rows.agg(F.count("*").alias("all"), F.count_if("_in").alias("members"), F.count_distinct(F.when(F.col("_in"), F.col(f"`{organization}`"))).alias("named"), *[m.alias(f"missing{k}") for k, m in enumerate(missing)])
    lines = [line("rows", None, F.col("all")), line("sector rows", None, F.col("members")), line("sector organizations", organization, F.col("named"))]
    lines += [line("missing per cent", c, F.col(f"missing{k}")) for k, c in enumerate(columns)]
    first = rows.filter("_in").orderBy(order).limit(samples).withColumn("_nth", F.row_number().over(Window.orderBy(order)))  # two rows
    shown = F.array(*[F.struct(F.lit(c).alias("column"), clean_text(F.col(f"`{c}`").cast("string")).alias("value")) for c in columns])
    examples = first.select(F.concat(F.lit("sample "), F.col("_nth").cast("string")).alias("section"), F.explode(shown).alias("c"))
    return (
        totals.select(F.explode(F.array(*lines)).alias("l")).select("l.*")
        .unionByName(values.withColumn("n", F.col("n").cast("double")))
        .unionByName(examples.select("section", "c.column", "c.value", F.lit(None).cast("double").alias("n")))
    )
