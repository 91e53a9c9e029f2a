"""Records of one large file found by several tasks, with columns only.

A file is read as text that Spark splits into blocks of ``maxPartitionBytes``.  Whether a
line break lies inside a quoted cell, or a brace inside an array's element, depends on all
text before it.  Each block is therefore summed up by what it does to the state at its
start; one row a block is enough to find every block's true starting state, and the
records that cross lines or blocks are joined by their number.  Blocks are sorted one by
one (a sort that spills); no task ever holds a whole file.  Compressed files cannot be
split and are one block each.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from demandgrid.session import ensure_checkpoint_dir

C = F.col
BLOCK = ["_file", "_start"]


def _window(before: bool, blocks: bool = False):
    """Rows of a block in order, or a file's blocks (one row each, so a small group); up to or before the current one."""
    w = W.partitionBy("_file").orderBy("_start") if blocks else W.partitionBy(*BLOCK).orderBy("_row")
    return w.rowsBetween(W.unboundedPreceding, -1 if before else 0)


def pieces(spark: SparkSession, path: str, separator: str) -> DataFrame:
    """_file, _start (of the block), _row (order inside the block) and text between separators."""
    return spark.read.option("lineSep", separator).text(path).select(
        C("_metadata.file_path").alias("_file"), C("_metadata.file_block_start").alias("_start"), F.monotonically_increasing_id().alias("_row"), C("value").alias("text"))


def _total(value: Column, before: bool = True, blocks: bool = False) -> Column:
    return F.coalesce(F.sum(value).over(_window(before, blocks)), F.lit(0)).cast("bigint")


def _states(df: DataFrame, starts: dict[str, int], blocks: bool = False) -> DataFrame:
    """The state (0 or 1) before each row, for every named state before the first.

    ``_zero`` and ``_one`` are the states after a row for a state of 0 and of 1 before it:
    a row keeps the state, flips it or sets it.  The last row that sets it and the
    flips since then decide."""
    flip, sets = (C("_zero") == 1) & (C("_one") == 0), C("_zero") == C("_one")
    df = df.withColumn("_turns", _total(flip.cast("int"), False, blocks))
    window = _window(True, blocks)
    df = df.withColumns({"_all": F.coalesce(F.last("_turns").over(window), F.lit(0)), "_set": F.last(F.when(sets, F.struct(C("_zero").alias("to"), C("_turns").alias("turns"))), True).over(window)})
    since = C("_all") - F.coalesce(C("_set.turns"), F.lit(0))
    return df.withColumns({name: ((F.coalesce(C("_set.to"), F.lit(start)) + since) % 2).cast("int") for name, start in starts.items()}).drop("_turns", "_all", "_set")


def _ends_open(line: Column, sep: str) -> Column:
    """Whether a line that starts outside quotes ends inside a quoted cell.

    A quote opens a cell only at its first character; in the cell two quotes are one
    character and a single one closes it.  Possessive parts run without recursion."""
    s = re.escape(sep)
    inside = '[^"]*+(?:""[^"]*+)*+'
    return line.rlike(f'^(?:(?:"{inside}"[^{s}]*+|[^"{s}][^{s}]*+|){s})*+"{inside}\\z').cast("int")


def csv_records(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    """_file, _record (0: the file's header), _pos, text of every record; line breaks in cells kept.

    Lines end with \\n or \\r\\n.  Blank lines outside cells are no records; a cell that
    is never closed runs to the end of its file.  Only the lines of records that cross
    lines are grouped."""
    bare = F.regexp_replace("text", r"\r$", "")
    lines = pieces(spark, path, "\n").withColumns({"_zero": _ends_open(bare, sep), "_one": _ends_open(F.concat(F.lit('"'), bare), sep), "_blank": F.trim(bare) == ""})
    # both cases of the block's start are followed until the start is known
    both = _states(lines, {"_s0": 0, "_s1": 1}).withColumns({
        "_b0": ((C("_s0") == 0) & ~C("_blank")).cast("bigint"), "_b1": ((C("_s1") == 0) & ~C("_blank")).cast("bigint")})
    # the file is read twice: the first pass moves flags only, the second the text, once
    end = lambda s: F.max_by(F.when(C(s) == 0, C("_zero")).otherwise(C("_one")), "_row")
    blocks = both.groupBy(*BLOCK).agg(end("_s0").alias("_zero"), end("_s1").alias("_one"), F.sum("_b0").alias("_n0"), F.sum("_b1").alias("_n1"))
    starts = _states(blocks, {"_state": 0}, True)
    starts = starts.withColumn("_first", _total(F.when(C("_state") == 0, C("_n0")).otherwise(C("_n1")), blocks=True)).select(*BLOCK, "_state", "_first")
    pick = lambda a, b: F.when(C("_state") == 0, C(a)).otherwise(C(b))
    rows = both.join(starts, BLOCK).withColumns({"_in": pick("_s0", "_s1"), "_begins": pick("_b0", "_b1")}).withColumn(
        "_record", C("_first") + _total(C("_begins"), False) - 1).where((C("_begins") == 1) | (C("_in") == 1))
    pos = F.struct(C("_file").alias("file"), C("_start").alias("start"), C("_row").alias("row"))
    rows = rows.select("_file", "_record", pos.alias("_pos"), "text", ((C("_begins") == 1) & (C("_zero") == 0)).alias("_whole"))
    parts = rows.where(~C("_whole")).groupBy("_file", "_record").agg(F.min("_pos").alias("_pos"), F.sort_array(F.collect_list(F.struct("_pos", "text"))).alias("_lines"))
    joined = parts.select("_file", "_record", "_pos", F.array_join(F.transform("_lines", lambda x: x["text"]), "\n").alias("text"))
    out = rows.where("_whole").select("_file", "_record", "_pos", "text").unionByName(joined)
    return out.withColumn("text", F.regexp_replace("text", r"\r$", ""))


def json_elements(spark: SparkSession, path: str, schema: str, key: str | None = "elements", kind: str = "{") -> DataFrame:
    """_file, _element (order in the file) and e: the elements of one large JSON array.

    The array is the value of ``key`` in the file's object, or with no key the file's
    top level.  ``kind`` is the bracket of its elements (numbers and NULLs between them
    are skipped); text is cut where that bracket closes, and pieces belong together until
    the depth is the array's again.  Brackets and quotes inside strings do not count.
    A file without the array has no elements."""
    ensure_checkpoint_dir(spark)
    shut = {"{": "}", "[": "]"}[kind]
    level = 1 if key is None else 2
    plain = lambda text: F.regexp_replace(text, r"\\.", "")
    quotes = lambda text: F.length(text) - F.length(F.replace(text, F.lit('"')))
    count = lambda text, chars: F.length(text) - F.length(F.translate(text, chars, ""))

    def rise(text: Column, quoted: bool) -> Column:
        """Brackets opened less brackets closed outside strings, of a text that starts inside one or not."""
        outside = F.regexp_replace(F.concat(F.lit('"'), text) if quoted else text, r'"[^"]*+(?:"|\z)', "")
        return count(outside, "{[") - count(outside, "}]")

    # the piece's own end is a closing bracket only outside a string
    cut = pieces(spark, path, shut).withColumn("_plain", plain(C("text"))).withColumn("_odd", (quotes(C("_plain")) % 2).cast("bigint"))
    cut = cut.withColumns({"_d0": rise(C("_plain"), False) - (1 - C("_odd")), "_d1": rise(C("_plain"), True) - C("_odd"), "_flips": _total(C("_odd")) % 2}).drop("_plain")
    cut = cut.withColumns({"_up0": F.when(C("_flips") == 0, C("_d0")).otherwise(C("_d1")), "_up1": F.when(C("_flips") == 0, C("_d1")).otherwise(C("_d0"))}).drop("_d0", "_d1")
    # both cases of the block's start (outside a string, inside one) are followed until it is known
    cut = cut.withColumns({"_r0": _total(C("_up0"), False), "_r1": _total(C("_up1"), False)}).checkpoint()
    blocks = cut.groupBy(*BLOCK).agg(F.sum("_odd").alias("_sum"), F.sum("_up0").alias("_sum0"), F.sum("_up1").alias("_sum1"))
    blocks = blocks.withColumn("_state", _total(C("_sum"), blocks=True) % 2)
    blocks = blocks.withColumn("_base", _total(F.when(C("_state") == 0, C("_sum0")).otherwise(C("_sum1")), blocks=True)).select(*BLOCK, "_state", "_base")
    pick = lambda a, b: F.when(C("_state") == 0, C(a)).otherwise(C(b))
    at = cut.join(blocks, BLOCK).withColumn("_depth", C("_base") + pick("_r0", "_r1")).withColumns({"_from": C("_depth") - pick("_up0", "_up1"), "_quoted": (C("_state") + C("_flips")) % 2 == 1})
    closes = ((C("_quoted").cast("int") + C("_odd")) % 2 == 0) & (C("_depth") <= level)

    # the array's own bracket: the key (no string holds a bare quote) where the depth is the array's
    opening = r"^[^\"{}\[\]]*?\[" if key is None else rf'"{re.escape(key)}"\s*:\s*\['
    lead = plain(F.regexp_extract("text", rf"(?s)^(.*?)(?:{opening.removeprefix('^')})", 1))
    depth = C("_from") + F.when(C("_quoted"), rise(lead, True)).otherwise(rise(lead, False))
    head = C("text").rlike(opening) & (depth == level - 1) & (~C("_quoted") if key is None else F.lit(True))
    rest = F.regexp_extract("text", rf"(?s){opening}(.*)\z", 1)
    at = at.withColumns({"_closes": closes.cast("bigint"), "_head": head}).withColumn("text", F.when(C("_head"), rest).otherwise(C("text")))
    over = (C("_head") | ((C("_from") == level) & ~C("_quoted"))) & F.concat("text", F.lit(shut)).rlike(r'^[^"{}\[\]]*+\]')
    ends = at.groupBy(*BLOCK).agg(F.sum("_closes").alias("_n")).withColumn("_first", _total(C("_n"), blocks=True)).select(*BLOCK, "_first")
    at = at.withColumn("_over", over).join(ends, BLOCK).withColumn("_element", C("_first") + _total(C("_closes")))

    heads = at.where("_head").groupBy("_file").agg(F.min(F.struct("_element", "_start", "_row")).alias("_h"))
    last = at.where("_over").join(heads, "_file").where(C("_element") >= C("_h._element")).groupBy("_file").agg(F.min("_element").alias("_to"))
    inside = at.join(heads, "_file").join(last, "_file", "left").where((F.struct("_element", "_start", "_row") >= C("_h")) & (C("_to").isNull() | (C("_element") < C("_to"))))
    part = F.struct("_start", "_row", "text", "_depth")
    groups = inside.groupBy("_file", "_element").agg(F.sort_array(F.collect_list(part)).alias("_parts"))
    text = F.concat(F.array_join(F.transform("_parts", lambda x: x["text"]), shut), F.lit(shut))
    text = F.regexp_extract(text, rf"(?s)^[^\"{{}}\[\]]*+(\{kind}.*)\z", 1)
    return groups.where(F.element_at("_parts", -1)["_depth"] == level).select("_file", "_element", text.alias("text")).where(C("text") != "").select("_file", "_element", F.from_json("text", schema).alias("e"))
