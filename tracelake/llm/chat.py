"""Chat formatting by relational operations only.

Turns are sorted as collected structs, adjacent turns of one role become one block, and texts are joined by
Spark expressions. A loss mask has one run (characters, trained or not) for each mark, role and text of the
formatted conversation that isn't empty, in order, so it is built and read back without prefix sums.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The template's marks. A block is START role TEXT turn (NEXT turn)* END.
START, TEXT, NEXT, END = "<|start|>", "<|text|>", "<|next|>", "<|end|>"
#: Control strings, of this template and of common others, that no text may hold unescaped.
CONTROL = (START, TEXT, NEXT, END, "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|im_start|>", "<|im_end|>", "<|endoftext|>", "<|user|>", "<|assistant|>", "<|system|>")

_REST = "|".join(sorted("".join("\\" + c if not c.isalnum() and c != "_" else c for c in x[1:]) for x in CONTROL))
_OPEN = "([<\\[])"


def escape(text: Column) -> Column:
    """The text with one more backslash inside each control string, after its first character."""
    return F.regexp_replace(text, f"{_OPEN}(\\\\*)(?={_REST})", r"$1$2\\")


def unescape(text: Column) -> Column:
    """What :func:`escape` was given."""
    return F.regexp_replace(text, f"{_OPEN}(\\\\*)\\\\(?={_REST})", "$1$2")


def format_conversations(turns: DataFrame, *, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", train_on: str = "assistant") -> DataFrame:
    """(id_col, formatted, mask array of (chars, train)) of every conversation.

    Turns are ordered by turn, then role, then text; a null turn comes first; repeated rows stay; a null
    role or text is empty; rows with a null id are one conversation. Of ``train_on`` turns the whole escaped
    text is under the mask, and nothing else. An empty table gives no rows; other columns are ignored. A
    conversation is one value, so it must fit one row; conversations of any number are dealt by their ids.
    """
    some = turns.select(
        F.col(id_col).alias("id"),
        F.struct(
            F.col(turn_col).cast("long").alias("turn"),
            F.coalesce(F.col(role_col).cast("string"), F.lit("")).alias("role"),
            F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
        ).alias("t"),
    )
    some = some.select("id", F.struct("t.turn", "t.role", "t.text", escape(F.col("t.role")).alias("r"), escape(F.col("t.text")).alias("x")).alias("t"))
    own = some.groupBy("id").agg(F.array_sort(F.collect_list("t")).alias("turns")).withColumn("n", F.size("turns"))
    # where a block begins, by comparing neighbours; then one slice of turns a block
    at = lambda k: F.get("turns", k)
    begins = F.filter(F.sequence(F.lit(0), F.col("n") - 1), lambda k: (k == 0) | (at(k)["role"] != at(k - 1)["role"]))
    own = own.withColumn("begins", begins)
    ends = F.concat(F.slice("begins", 2, F.greatest(F.size("begins"), F.lit(1))), F.array("n"))
    own = own.withColumn("ends", ends)
    block = F.transform("begins", lambda b, k: F.struct(at(b)["role"].alias("role"), at(b)["r"].alias("r"), F.transform(F.slice("turns", b + 1, F.get("ends", k) - b), lambda t: t["x"]).alias("texts")))
    own = own.withColumn("blocks", block)
    text = F.array_join(F.transform("blocks", lambda b: F.concat(F.lit(START), b["r"], F.lit(TEXT), F.array_join(b["texts"], NEXT), F.lit(END))), "")
    run = lambda chars, train: F.struct(chars.cast("long").alias("chars"), F.lit(train).alias("train") if isinstance(train, bool) else train.alias("train"))
    runs = F.transform(
        "blocks",
        lambda b: F.concat(
            F.array(run(F.lit(len(START)), False), run(F.char_length(b["r"]), False), run(F.lit(len(TEXT)), False)),
            F.flatten(F.transform(b["texts"], lambda x, k: F.array(run(F.when(k == 0, 0).otherwise(len(NEXT)), False), run(F.char_length(x), b["role"] == train_on)))),
            F.array(run(F.lit(len(END)), False)),
        ),
    )
    mask = F.filter(F.flatten(runs), lambda r: r["chars"] > 0)
    return own.select(F.col("id").alias(id_col), text.alias("formatted"), mask.alias("mask"))


def read_back(formatted: DataFrame, *, text_col: str = "formatted", mask_col: str = "mask") -> DataFrame:
    """``formatted`` with turns (array of role, text) and trained, the texts under the mask, unescaped.

    The text is cut at its marks; the mask's runs are counted off against the same cuts. trained is null
    where they don't fit. A null text has null turns. All columns come back as they were; none may be called
    turns or trained.
    """
    if clash := {"turns", "trained"} & set(formatted.columns):
        raise ValueError(f"conversations already have {sorted(clash)}")
    marks = "|".join("\\Q" + m + "\\E" for m in (START, TEXT, NEXT, END))
    own = formatted.select(F.struct(*formatted.columns).alias("row"), F.col(text_col).alias("text"), F.col(mask_col).alias("mask"))
    block = F.filter(F.split("text", "\\Q" + START + "\\E"), lambda b: b != "")
    own = own.withColumn("blocks", F.transform(block, lambda b: F.split(F.regexp_replace(b, "\\Q" + END + "\\E$", ""), "\\Q" + TEXT + "\\E", 2)))
    turns = F.flatten(F.transform("blocks", lambda b: F.transform(F.split(F.get(b, F.lit(1)), "\\Q" + NEXT + "\\E", -1), lambda x: F.struct(unescape(F.get(b, F.lit(0))).alias("role"), unescape(x).alias("text")))))
    own = own.withColumn("turns", turns)
    cuts = F.filter(F.split("text", f"(?={marks})|(?<={marks})"), lambda x: x != "")
    own = own.withColumn("cuts", cuts)
    fits = (F.size("cuts") == F.size("mask")) & F.forall(F.zip_with("cuts", "mask", lambda x, r: F.char_length(x) == r["chars"]), lambda ok: F.coalesce(ok, F.lit(False)))
    under = F.transform(F.filter(F.zip_with("cuts", "mask", lambda x, r: F.struct(x.alias("x"), r["train"].alias("train"))), lambda p: p["train"]), lambda p: unescape(p["x"]))
    return own.select("row.*", "turns", F.when(fits, under).alias("trained"))
