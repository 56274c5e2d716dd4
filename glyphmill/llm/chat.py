"""Chat formatting of reply trees.

Messages form trees by parent ids. Iterative self-joins enumerate the root-to-leaf paths: a table of jumps
doubles its reach in every round (a message's 2^k-th ancestor joined with that one's), and in the same round
every path found so far gains the jump's target. The rounds are the logarithm of the depth. Branches are
ranked by score, and each chosen path is formatted as one conversation.

Format: a turn is ``<|role|>`` + escaped role + ``\\n`` + escaped text + ``<|end|>\\n``. Every ``<|`` in a role or
text is written ``<\\|``, and every run of backslashes between ``<`` and ``|`` gets one more, so no text can imitate
a control string and escaping is undone exactly; a newline within a role is ``<|newline|>``. The loss mask covers assistant texts.
"""

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import written

TURN, END, NEWLINE = "<|role|>", "<|end|>\n", "<|newline|>"
LEARNED = "assistant"


def escaped(c: Column) -> Column:
    return F.regexp_replace(c, r"<(\\*)\|", r"<$1\\|")


def unescape(text: str) -> str:
    return re.sub(r"<\\(\\*)\|", r"<\1|", text)


def paths(messages: DataFrame) -> DataFrame:
    """``leaf``, ``node`` and ``steps`` (0 at the leaf) for every message of every root-to-leaf path.

    ``messages`` has unique ``node`` and ``parent`` (null, or absent from ``node``, at roots). Its rows grow with
    the paths' total length. Messages whose ancestors run into a cycle are on no path: among the others,
    fewer have an ancestor at each doubled distance, so a round that loses none shows them.
    """
    nodes = messages.select("node", "parent")
    known = nodes.select(F.col("node").alias("known"))
    jumps = written(nodes.where("parent is not null").join(known, F.col("parent") == F.col("known"), "left_semi").select("node", F.col("parent").alias("far")), "chat-jumps")
    parents = jumps.select(F.col("far").alias("node")).distinct()
    found = written(nodes.select("node").join(parents, "node", "left_anti").select(F.col("node").alias("leaf"), "node", F.lit(0).cast("long").alias("steps")), "chat-paths")
    reach, left, before = 1, jumps.count(), None
    while left:
        if left == before:
            return paths(messages.join(jumps.select("node"), "node", "left_anti"))
        before = left
        further = found.join(jumps, "node").select("leaf", F.col("far").alias("node"), (F.col("steps") + reach).alias("steps"))
        found = written(found.unionByName(further), "chat-paths")
        twice = jumps.alias("a").join(jumps.alias("b"), F.col("a.far") == F.col("b.node")).select(F.col("a.node").alias("node"), F.col("b.far").alias("far"))
        jumps = written(twice, "chat-jumps")
        reach, left = 2 * reach, jumps.count()
    return found


def ranked_paths(messages: DataFrame, found: DataFrame, best: int | None) -> DataFrame:
    """The paths of the ``best`` leaves of each tree by mean score (ties: the smaller leaf); all if None."""
    if best is None:
        return found
    scored = found.join(messages.select("node", "tree", "score"), "node")
    leaves = scored.groupBy("leaf").agg(F.first("tree").alias("tree"), F.avg(F.coalesce("score", F.lit(0.0))).alias("mean"))
    order = Window.partitionBy("tree").orderBy(F.desc("mean"), "leaf")
    chosen = leaves.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= best).select("leaf")
    return found.join(chosen, "leaf", "left_semi")


def format_trees(messages: DataFrame, best: int | None = 1) -> DataFrame:
    """One row for each chosen root-to-leaf path: ``tree``, ``leaf``, ``n_turns``, ``formatted`` and ``mask``
    (array of start and length, in code points, of what a loss is taken on).

    ``messages``: ``tree``, ``node`` (unique), ``parent``, ``role``, ``text``, ``score``. Null roles, texts and scores count
    as empty and 0; other columns are not read; an empty table gives no rows. ``best``: how many branches
    of a tree are chosen, by mean score.
    """
    chosen = ranked_paths(messages, paths(messages), best)
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    said = messages.select("node", "tree", F.concat(F.lit(TURN), F.replace(escaped(role), F.lit("\n"), F.lit(NEWLINE)), F.lit("\n")).alias("head"), escaped(text).alias("body"), (role == LEARNED).alias("learned"))
    turns = chosen.join(said, "node").groupBy("leaf").agg(F.first("tree").alias("tree"), F.array_sort(F.collect_list(F.struct((-F.col("steps")).alias("at"), "head", "body", "learned"))).alias("turns"))
    sized = F.transform("turns", lambda t: F.struct(F.length(t["head"]).alias("head"), F.length(t["body"]).alias("body"), t["learned"].alias("learned")))
    state = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:long,length:long>>").alias("mask"))

    def turn(s, t):
        begin = s["at"] + t["head"]
        span = F.array(F.struct(begin.cast("long").alias("start"), t["body"].cast("long").alias("length")))
        return F.struct((begin + t["body"] + len(END)).cast("long").alias("at"), F.when(t["learned"], F.concat(s["mask"], span)).otherwise(s["mask"]).alias("mask"))

    whole = F.array_join(F.transform("turns", lambda t: F.concat(t["head"], t["body"], F.lit(END))), "")
    return turns.select("tree", "leaf", F.size("turns").cast("long").alias("n_turns"), whole.alias("formatted"), F.aggregate(sized, state, turn)["mask"].alias("mask"))


def parse(formatted: str) -> list[tuple[str, str]]:
    """Roles and texts of a formatted conversation."""
    out = []
    for part in formatted.split(END)[:-1]:
        head, _, body = part[len(TURN) :].partition("\n")
        out.append(("\n".join(map(unescape, head.split(NEWLINE))), unescape(body)))
    return out


def from_turns(conversations: DataFrame) -> DataFrame:
    """Linear conversations (``conv_id``, ``turn``, ``role``, ``text``) as reply trees: each row answers the row
    before it in the order of turn, role and text. Rows that repeat are turns of their own."""
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    numbered = conversations.select("conv_id", "turn", "role", "text").withColumn("n", F.row_number().over(order))
    node = lambda n: F.struct(F.col("conv_id"), n.alias("n"))
    return numbered.select(F.col("conv_id").alias("tree"), node(F.col("n")).alias("node"), F.when(F.col("n") > 1, node(F.col("n") - 1)).alias("parent"), "role", "text", F.lit(1.0).alias("score"))


def read_back(formatted: DataFrame) -> DataFrame:
    """Digests of each formatted conversation, from its string and mask alone: see ``op9`` in queries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for begin in range(0, whole.num_rows, 500):
                batch, out = whole.slice(begin, 500), [[] for _ in range(5)]
                for text, mask in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                    turns = parse(text)
                    learned = "".join(unescape(text[m["start"] : m["start"] + m["length"]]) for m in mask)
                    said = "".join(f"{r}\n{t}\n" for r, t in turns)
                    row = (len(turns), hashlib.sha256(said.encode()).hexdigest(), len(learned), hashlib.sha256(learned.encode()).hexdigest(), len(text))
                    for column, value in zip(out, row):
                        column.append(value)
                yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(out, [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]))], ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    read = formatted.select(F.col("tree").alias("conv_id"), "formatted", "mask")
    kind = read.schema["conv_id"].dataType.simpleString()
    return read.mapInArrow(run, f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
