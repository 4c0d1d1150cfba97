"""Chat formatting in budgeted windows, in DataFrame functions only.

A conversation is cut into windows at turn borders. Prefix sums of turn tokens choose the cuts: turns whose
first token lies in the same stride of the conversation share a window, and a turn longer than a stride has
one to itself, so a window's new turns stay within two strides unless a single turn is longer. Each later
window starts with all system turns before it and a limited history (the last turns of the window before it, up to
a token budget, or its last turn alone where the window has room for it). System turns take their real length off
the conversation's budget before the cuts are chosen; a stride keeps ``LEAST_STRIDE`` tokens, so windows grow over
the budget only by a longer turn or by system turns that leave less. Repeated turns are context only: their text
is outside the loss mask.

Turns are written as ``<|turn|>role<|text|>text<|end|>``. Inside roles and texts every ``<|`` gets a backslash
after ``<`` (and each ``<\\..|`` one more), which ``unescaped`` takes away again.

Defined cases: null texts and roles are empty; turns are ordered by turn (null first), role and text, and
repeated rows are turns of their own; null conversation ids form one conversation; an empty table gives an
empty result; other columns are ignored. All turns of one conversation meet in one task, as windows and digest need
them in order. Formatting holds sorted rows, which spill, and one window at a time; ``read_back`` holds the texts of one
conversation, of which it makes a hash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
BUDGET, SYSTEM_BUDGET, HISTORY_BUDGET, LEAST_STRIDE = 2048, 256, 256, 256


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<$1\\|")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\\\|", r"<$1|")


def n_tokens(text: Column) -> Column:
    """Estimate: four bytes a token, and four tokens of markup a turn."""
    return F.expr("0").cast("long") + F.floor((F.octet_length(text) + 3) / 4).cast("long") + 4


def windows(conv: DataFrame, budget: int = BUDGET, system_budget: int = SYSTEM_BUDGET, history: int = HISTORY_BUDGET) -> DataFrame:
    """conv_id, window, pos, repeated, role, text: every turn in each window that shows it."""
    turns = conv.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    by = Window.partitionBy("conv_id")
    order = by.orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    t = turns.withColumn("pos", (F.row_number().over(order) - 1).cast("long")).withColumn("tok", n_tokens(F.col("text")))
    system = F.col("role") == "system"
    t = t.withColumn("system", F.greatest(F.lit(system_budget).cast("long"), F.coalesce(F.sum(F.when(system, F.col("tok"))).over(by), F.lit(0))))
    stride = F.greatest(F.lit(LEAST_STRIDE).cast("long"), F.floor((F.lit(budget) - F.col("system") - history) / 2))
    seq = by.orderBy("pos")
    upto = seq.rowsBetween(Window.unboundedPreceding, -1)
    t = t.withColumn("block", F.floor(F.coalesce(F.sum("tok").over(upto), F.lit(0)) / stride))
    cut = (F.col("pos") == 0) | (F.col("block") != F.lag("block").over(seq)) | (F.col("tok") > stride) | (F.lag("tok").over(seq) > stride)
    t = t.withColumn("cut", F.when(cut, 1).otherwise(0))
    t = t.withColumn("window", (F.sum("cut").over(seq.rowsBetween(Window.unboundedPreceding, 0)) - 1).cast("long"))
    tail = Window.partitionBy("conv_id", "window").orderBy(F.col("pos").desc()).rowsBetween(Window.unboundedPreceding, 0)
    t = t.withColumn("tail", F.sum("tok").over(tail)).withColumn("last", F.max("window").over(by))
    t = t.withColumn("fresh", F.sum("tok").over(Window.partitionBy("conv_id", "window")))
    t = t.withColumn("room", F.when(F.lead("window").over(seq) != F.col("window"), budget - F.col("system") - F.lead("fresh").over(seq)))
    following = (F.col("window") + 1).cast("int")
    more = F.col("window") < F.col("last")
    later = F.when(system & more, F.sequence(following, F.greatest(F.col("last").cast("int"), following)))
    later = later.when(more & ((F.col("tail") <= history) | (F.col("tok") <= F.col("room"))), F.array(following))
    shown = F.concat(F.array(F.col("window").cast("int")), F.coalesce(later, F.array().cast("array<int>")))
    out = t.select("conv_id", F.col("window").alias("own"), "pos", "role", "text", F.explode(shown).alias("window"))
    return out.select("conv_id", F.col("window").cast("long").alias("window"), "pos", (F.col("window") != F.col("own")).alias("repeated"), "role", "text")


def formatted(conv: DataFrame, **budgets: int) -> DataFrame:
    """conv_id, window, text, n_repeated and loss_spans (start, length in code points) of every window."""
    w = windows(conv, **budgets)
    w = w.withColumn("head", F.concat(F.lit(TURN), escaped(F.col("role")), F.lit(TEXT))).withColumn("body", escaped(F.col("text")))
    w = w.withColumn("n_head", F.char_length("head").cast("long")).withColumn("n_body", F.char_length("body").cast("long"))
    upto = Window.partitionBy("conv_id", "window").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    w = w.withColumn("at", F.coalesce(F.sum(F.col("n_head") + F.col("n_body") + len(END)).over(upto), F.lit(0)))
    span = F.when((F.col("role") == "assistant") & ~F.col("repeated"), F.struct((F.col("at") + F.col("n_head")).alias("start"), F.col("n_body").alias("length")))
    parts = F.sort_array(F.collect_list(F.struct("pos", F.concat("head", "body", F.lit(END)).alias("piece"), span.alias("span"))))
    w = w.groupBy("conv_id", "window").agg(parts.alias("p"), F.sum(F.col("repeated").cast("long")).alias("n_repeated"))
    return w.select("conv_id", "window", F.array_join("p.piece", "").alias("text"), "n_repeated", F.filter("p.span", lambda s: s.isNotNull()).alias("loss_spans"))


def read_back(windows_: DataFrame) -> DataFrame:
    """Per conversation, from its formatted windows alone: its turns' digest and the text under the mask."""
    pieces = F.split("text", r"<\|end\|>")
    fresh = F.slice(pieces, (F.col("n_repeated") + 1).cast("int"), F.greatest(F.size(pieces) - 1 - F.col("n_repeated"), F.lit(0)).cast("int"))
    plain = F.transform(fresh, lambda p: F.concat(unescaped(F.substring_index(F.substr(p, F.lit(len(TURN) + 1)), TEXT, 1)), F.lit("\n"), unescaped(F.substr(p, F.instr(p, TEXT) + len(TEXT))), F.lit("\n")))
    loss = F.transform("loss_spans", lambda s: unescaped(F.substr(F.col("text"), (s["start"] + 1).cast("int"), s["length"].cast("int"))))
    w = windows_.select("conv_id", "window", F.size(fresh).cast("long").alias("n"), F.array_join(plain, "").alias("plain"), F.array_join(loss, "").alias("loss"), F.char_length("text").cast("long").alias("chars"))
    g = w.groupBy("conv_id").agg(F.sum("n").alias("n_turns"), F.sort_array(F.collect_list(F.struct("window", "plain", "loss"))).alias("p"), F.sum("chars").alias("formatted_chars"))
    whole, lost = F.array_join("p.plain", ""), F.array_join("p.loss", "")
    return g.select("conv_id", "n_turns", F.sha2(whole.cast("binary"), 256).alias("turns_sha256"), F.char_length(lost).cast("long").alias("loss_chars"), F.sha2(lost.cast("binary"), 256).alias("loss_sha256"), "formatted_chars")
