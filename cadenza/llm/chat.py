"""Chat formatting in budgeted, turn-aligned windows; DataFrame functions only.

A turn is rendered as ``<|turn|>role\\ntext<|end|>\\n``. Control strings inside roles and texts are
escaped with ``~``, reversibly. Prefix sums of turn tokens deal a conversation's turns to windows: a window ends
with the last turn whose sum, less the sum where the window begins, stays in its budget, of which the system turn and
the history that it repeats are parts; only assistant texts that aren't repeats are under the loss mask.

Rows are shuffled once, by conversation, as they come. Where windows begin follows from the sums alone, one number
for each turn of a conversation; texts meet in blocks of turns on their way to their windows and never in whole
conversations. Blocks decide nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TURN, END = "<|turn|>", "<|end|>"
#: Turns of a block, in which texts look up where windows begin.
BLOCK_TURNS = 1024


def escape(c: Column, line: bool = False) -> Column:
    """Escape control strings; with ``line`` also newlines, for roles."""
    c = F.replace(c, F.lit("~"), F.lit("~0"))
    c = F.regexp_replace(c, r"\[(?=/?INST\])", "~2")
    c = F.regexp_replace(c, r"<(?=\||/?s>|/?<SYS|/?<|/?SYS)", "~1")
    return F.replace(c, F.lit("\n"), F.lit("~3")) if line else c


def unescape(c: Column) -> Column:
    for code, plain in (("~1", "<"), ("~2", "["), ("~3", "\n"), ("~0", "~")):
        c = F.replace(c, F.lit(code), F.lit(plain))
    return c


def tokens(c: Column) -> Column:
    """The token measure of budgets: words and single marks."""
    return F.regexp_count(c, F.lit(r"\w+|[^\w\s]")).cast("long")


def _length(pieces: Column, of: str) -> Column:
    return F.aggregate(pieces, F.lit(0).cast("long"), lambda total, x: total + x[of])


def format_windows(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", budget: int = 512, history: int = 128) -> DataFrame:
    """(conversation, conv_id, window, formatted, n_repeated, loss): one row per window, windows numbered in order.

    Every window but a conversation's first repeats the system turn, if there is one, and then the last
    turns of the window before, as far as they hold at most ``history`` tokens. Turns follow while they fit: a window holds at most ``budget`` tokens, repeats
    included, unless its one own turn is too long for that. ``history`` tokens stay reserved for repeats.

    ``n_repeated``: how many turns at the front are repeats. ``loss``: array of (begin, length) in code
    points of ``formatted``. The system turn is a first turn whose role is ``system``. Turns are ordered by
    number, then role, then text (repeated rows are turns of their own); null roles and texts count as
    empty, a null number comes first, null conversation ids form one conversation. Other columns are
    left out. A conversation is one key of the shuffle; ``conversation`` is that key, by which rows stay partitioned.
    """
    # a null id is a key like others inside a struct, so that one partitioning serves all steps
    t = df.select(F.struct(F.col(conv_col).alias("id")).alias("c"), F.col(turn_col).cast("long").alias("n"), F.coalesce(F.col(role_col).cast("string"), F.lit("")).alias("role"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    ordered = Window.partitionBy("c").orderBy(F.asc_nulls_first("n"), "role", "text").rowsBetween(Window.unboundedPreceding, 0)
    t = t.select("c", "role", "text", (F.row_number().over(ordered) - 1).alias("i"), F.first(F.struct("role", "text")).over(ordered).alias("top"))
    head = lambda role: F.concat(F.lit(TURN), escape(role, line=True), F.lit("\n"))
    piece = lambda role, text: F.concat(head(role), escape(text), F.lit(END + "\n"))
    t = t.select("c", F.floor(F.col("i") / BLOCK_TURNS).alias("b"), "i", "top", head(F.col("role")).alias("head"), piece(F.col("role"), F.col("text")).alias("piece"), (F.col("role") == "assistant").alias("answer"))
    size = F.length("piece").cast("long")
    turn = F.struct("i", "piece", tokens(F.col("piece")).alias("k"), size.alias("m"), F.length("head").cast("long").alias("h"), (size - F.length("head") - len(END) - 1).alias("l"), "answer")
    sys = F.when(F.col("top.role") == "system", piece(F.col("top.role"), F.col("top.text")))

    # the prefix sums of a conversation: after each turn
    sums = t.groupBy("c").agg(F.sort_array(F.collect_list(F.struct("i", tokens(F.col("piece")).alias("k")))).alias("ks"), F.first("top").alias("top"))
    sums = sums.select("c", "ks", sys.alias("sys"))
    sums = sums.withColumn("room", F.greatest(F.lit(1), budget - history - F.coalesce(tokens(F.col("sys")), F.lit(0))).cast("long"))

    # where windows begin, by block: at a turn whose sum passes the room of its window, unless that window would be empty;
    # a conversation's first window repeats nothing, so its room is the budget
    def deal(a: Column, x: Column) -> Column:
        room = F.when(a["base"] == 0, F.lit(budget).cast("long")).otherwise(F.col("room"))
        full = (a["sum"] > a["base"]) & (a["sum"] + x["k"] - a["base"] > room)
        here = F.when(full, F.concat(a["here"], F.array((x["i"] % BLOCK_TURNS).cast("int")))).otherwise(a["here"])
        ends = x["i"] % BLOCK_TURNS == BLOCK_TURNS - 1
        return F.struct(
            (a["sum"] + x["k"]).alias("sum"), F.when(full, a["sum"]).otherwise(a["base"]).alias("base"), F.when(ends, F.array().cast("array<int>")).otherwise(here).alias("here"),
            F.when(ends, F.concat(a["starts"], F.array(here))).otherwise(a["starts"]).alias("starts"),
        )

    zero = F.struct(F.lit(0).cast("long").alias("sum"), F.lit(0).cast("long").alias("base"), F.array().cast("array<int>").alias("here"), F.array().cast("array<array<int>>").alias("starts"))
    starts = sums.select("c", "sys", F.aggregate("ks", zero, deal, lambda a: F.concat(a["starts"], F.array(a["here"]))).alias("starts"))

    # turns get the number of the window that is open there, and meet in it
    blocks = t.groupBy("c", "b").agg(F.sort_array(F.collect_list(turn)).alias("turns")).join(starts, "c")
    before = F.aggregate(F.slice("starts", F.lit(1), F.col("b").cast("int")), F.lit(0).cast("long"), lambda n, x: n + F.size(x))
    blocks = blocks.select("c", "sys", "turns", before.alias("before"), F.get("starts", F.col("b").cast("int")).alias("here"))
    dealt = blocks.select("c", "sys", F.explode(F.transform("turns", lambda x, p: F.struct((F.col("before") + F.size(F.filter("here", lambda y: y <= p))).alias("window"), x.alias("turn")))).alias("x"))
    windows = dealt.groupBy("c", F.col("x.window").alias("window")).agg(F.sort_array(F.collect_list("x.turn")).alias("own"), F.first("sys").alias("sys"))

    # the last turns of a window, counted from its end while they fit; the system turn isn't one of them
    def back(a: Column, x: Column) -> Column:
        fits = a["open"] & (a["k"] + x["k"] <= history) & ((x["i"] > 0) | F.col("sys").isNull())
        return F.struct((a["k"] + x["k"]).alias("k"), (a["n"] + fits.cast("int")).alias("n"), fits.alias("open"))

    none = F.struct(F.lit(0).cast("long").alias("k"), F.lit(0).alias("n"), F.lit(True).alias("open"))
    repeated = F.aggregate(F.reverse("own"), none, back, lambda a: a["n"])
    tail = F.slice("own", F.size("own") - repeated + 1, repeated)
    windows = windows.withColumn("old", F.lag(tail).over(Window.partitionBy("c").orderBy("window")))
    windows = windows.select("c", "window", F.when(F.col("window") > 0, F.col("sys")).alias("sys"), F.coalesce("old", F.slice("own", 1, 0)).alias("old"), "own")
    front = F.coalesce(F.length("sys"), F.lit(0)) + _length(F.col("old"), "m")

    def mask(a: Column, x: Column) -> Column:
        answer = F.struct((a["at"] + x["h"]).cast("int").alias("begin"), x["l"].cast("int").alias("length"))
        return F.struct((a["at"] + x["m"]).alias("at"), F.when(x["answer"], F.concat(a["loss"], F.array(answer))).otherwise(a["loss"]).alias("loss"))

    start = F.struct(front.cast("long").alias("at"), F.array().cast("array<struct<begin:int,length:int>>").alias("loss"))
    text = F.concat(F.coalesce("sys", F.lit("")), F.array_join(F.transform(F.concat("old", "own"), lambda x: x["piece"]), ""))
    n_repeated = F.size("old") + F.when(F.col("sys").isNotNull(), 1).otherwise(0)
    return windows.select(F.col("c").alias("conversation"), F.col("c.id").alias("conv_id"), "window", text.alias("formatted"), n_repeated.alias("n_repeated"), F.aggregate("own", start, mask, lambda a: a["loss"]).alias("loss"))


def read_windows(windows: DataFrame) -> DataFrame:
    """The windows with ``turns`` (array of (role, text)) and ``targets`` (array of texts) read back from ``formatted``.

    Only turns that aren't repeats are read, so over a conversation's windows each comes once.
    """
    parts = F.split(F.col("formatted"), r"<\|turn\|>")
    fresh = F.slice(parts, F.col("n_repeated") + 2, F.size(parts))
    cut = F.transform(fresh, lambda x: F.struct(F.substring_index(x, "\n", 1).alias("r"), x.alias("x")))
    turns = F.transform(cut, lambda y: F.struct(unescape(y["r"]).alias("role"), unescape(F.substring(y["x"], F.length(y["r"]) + 2, F.length(y["x"]) - F.length(y["r"]) - 2 - len(END))).alias("text")))
    targets = F.transform("loss", lambda x: unescape(F.substring(F.col("formatted"), x["begin"] + 1, x["length"])))
    return windows.withColumn("turns", turns).withColumn("targets", targets)


def conversation_digests(windows: DataFrame) -> DataFrame:
    """Per conversation, what ``read_windows`` finds: turn and loss counts and SHA-256 digests."""
    read = read_windows(windows).select("conversation", F.struct("window", "turns", "targets", F.length("formatted").alias("n")).alias("w"))
    each = read.groupBy("conversation").agg(F.sort_array(F.collect_list("w")).alias("w"))
    turns = F.flatten(F.transform("w", lambda x: x["turns"]))
    target = F.array_join(F.flatten(F.transform("w", lambda x: x["targets"])), "")
    said = F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    each = each.select(F.col("conversation.id").alias("conv_id"), turns.alias("turns"), target.alias("target"), F.aggregate("w", F.lit(0).cast("long"), lambda a, x: a + x["n"]).alias("formatted_chars"))
    return each.select("conv_id", F.size("turns").cast("long").alias("n_turns"), digest(said).alias("turns_sha256"), F.length("target").cast("long").alias("loss_chars"), digest(F.col("target")).alias("loss_sha256"), "formatted_chars")
