"""Chat formatting by rendering successive prefixes of a conversation.

A template is a black box from a list of turns to a string. Each prefix is rendered, and what
a prefix adds to the one before is its last turn's span. If an output does not begin with the
one before, the template rewrites history, and the place is reported. Rendering the last
turn once more with a probe for its text shows where inside the span the text lies.
"""
from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from gleaner.functions import group_positions
from gleaner.llm.common import by_value, map_groups

by_value(__name__)

Turn = tuple[str, str]
PROBE = "\ue000"
PIECE = 256           # turns of a conversation that are rendered together


class MarkedTurns:
    """`### role: text</turn>` for each turn.

    In roles and texts a backslash is doubled, one is put between two number signs, and one
    into `</turn>`; in roles also before a colon. So no mark can occur inside, and removing
    each backslash gives back what was there.
    """

    by_turn = True
    end = "</turn>\n"

    @staticmethod
    def escape(text: str) -> str:
        return re.sub("#(?=#)", r"#\\", text.replace("\\", "\\\\")).replace("</turn>", "<\\/turn>")

    @staticmethod
    def unescape(text: str) -> str:
        return re.sub(r"\\(.)", r"\1", text, flags=re.S)

    def render(self, turns: Sequence[Turn]) -> str:
        return "".join(f"### {self.escape(role).replace(':', chr(92) + ':')}: {self.escape(text)}{self.end}"
                       for role, text in turns)

    def parse(self, output: str) -> Iterator[Turn]:
        at = 0
        while at < len(output):
            mark = re.compile(r"### ((?:\\.|[^\\:])*): ", re.S).match(output, at)
            stop = output.index(self.end, mark.end())
            yield self.unescape(mark[1]), self.unescape(output[mark.end():stop])
            at = stop + len(self.end)


def located(template, turns: Sequence[Turn], before: Turn | None = None):
    """Output, per turn the spans (turn start, turn stop, text start, text stop), rewrites.

    `rewrites` lists the turns (from 0) at which the output of the prefix up to there does not
    begin with the prefix before; that turn's span begins where the two part. With `before`,
    the turn in front of these, 0 is listed if it changes how they are rendered. A text that
    the template drops or changes has the span of what stands in its place, or -1.
    """
    output, spans, rewrites = "", [], []
    for n in range(1, len(turns) + 1):
        now = template.render(turns[:n])
        start = len(output)
        if not now.startswith(output):
            rewrites.append(n - 1)
            start = next(i for i in range(len(output) + 1) if now[i:i + 1] != output[i:i + 1] or i == len(output))
        probe = template.render([*turns[:n - 1], (turns[n - 1][0], PROBE)])
        at = probe.find(PROBE, min(start, len(probe)))
        tail = len(probe) - at - 1
        known = at >= 0 and now[:at] == probe[:at] and now[len(now) - tail:] == probe[at + 1:]
        spans.append((start, len(now), at if known else -1, len(now) - tail if known else -1))
        output = now
    if before is not None and turns and template.render([before, *turns]) != template.render([before]) + output:
        rewrites.insert(0, 0)
    return output, spans, sorted(set(rewrites))


def by_turn(template) -> bool:
    """Whether the template's own class declares `by_turn`: each turn is rendered by itself, so
    the output of a conversation is that of its turns in a row. A class that inherits from such
    a one may render otherwise and must declare it anew.
    """
    return bool(vars(type(template)).get("by_turn", False))


def formatted(conversations: DataFrame, template=None, piece: int = PIECE) -> DataFrame:
    """conv_id, piece, output, spans, rewrites for every piece of every conversation.

    Rows of (conv_id, turn, role, text) are ordered by turn, then role and text, so ties and
    repeated rows have a fixed place; null roles and texts count as empty, a null turn is the
    first. Rows without conv_id belong to no conversation and are left out. Other columns are
    not read; an empty table gives no row.

    `spans` holds (role, turn_start, turn_stop, text_start, text_stop) in characters of the
    output. A template that declares `by_turn` renders a conversation of more than `piece` turns
    in pieces, which follow each other; each piece is also rendered behind the turn before it,
    and if that makes a difference it is reported in `rewrites` of that piece. So a conversation
    of any length is spread over tasks, and the cost of prefixes stays linear in its length.
    Any other template may look at all turns: it renders each conversation as one piece in one
    task, at a cost that grows with the square of its turns.
    """
    template = template or MarkedTurns()
    clean = conversations.filter("conv_id IS NOT NULL").select(
        "conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"))
    placed = group_positions(clean, ["conv_id"], ["turn", "role", "text"], "position", "chat")
    # the last turn of a piece is also handed to the next piece, as what stands before it
    cut = by_turn(template)
    part = F.floor(F.col("position") / piece) if cut else F.lit(0).cast("bigint")
    last = F.col("position") % piece == piece - 1 if cut else F.lit(False)
    handed = placed.select("*", F.explode(F.when(last, F.array(part, part + 1)).otherwise(F.array(part)))
                           .alias("piece")).withColumn("own", F.col("piece") == part)

    def show(group):
        order = sorted(range(len(group["position"])), key=lambda i: group["position"][i])
        turns = [(group["role"][i], group["text"][i]) for i in order if group["own"][i]]
        if not turns:
            return None
        front = [(group["role"][i], group["text"][i]) for i in order if not group["own"][i]]
        output, spans, rewrites = located(template, turns, front[0] if front else None)
        return {"conv_id": [group["conv_id"][0]], "piece": [group["piece"][0]], "output": [output],
                "spans": [[dict(zip(("role", "turn_start", "turn_stop", "text_start", "text_stop"), (r, *s)))
                           for (r, _), s in zip(turns, spans)]], "rewrites": [rewrites]}

    kind = conversations.schema["conv_id"].dataType.simpleString()
    return map_groups(handed, ["conv_id", "piece"],
                      f"conv_id {kind}, piece bigint, output string, spans array<struct<role:string,"
                      "turn_start:int,turn_stop:int,text_start:int,text_stop:int>>, rewrites array<int>", show)


def read_back(outputs: DataFrame, template=None, trained: Sequence[str] = ("assistant",)) -> DataFrame:
    """Counts and digests of each conversation, read from the outputs of `formatted`.

    Pieces stream through in order and only running digests are kept, so a conversation of
    any length needs the memory of one piece.
    """
    template = template or MarkedTurns()
    kind = outputs.schema["conv_id"].dataType.simpleString()
    schema = (f"conv_id {kind}, n_turns bigint, turns_sha256 string, loss_chars bigint,"
              " loss_sha256 string, formatted_chars bigint, n_rewrites bigint")
    names = [c.split()[0] for c in schema.split(", ")]

    arrow = to_arrow_schema(T.StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, done = None, []

        def row():
            conv, turns, all_, chars, loss, size, rewrites = state
            return conv, turns, all_.hexdigest(), chars, loss.hexdigest(), size, rewrites

        def batch_of(rows):
            return pa.RecordBatch.from_arrays(
                [pa.array([r[i] for r in rows], type=arrow.field(n).type) for i, n in enumerate(names)],
                schema=arrow)

        for batch in batches:
            for conv, output, spans, rewrites in zip(*(batch.column(c).to_pylist() for c in
                                                       ("conv_id", "output", "spans", "rewrites"))):
                if state is None or state[0] != conv:
                    if state is not None:
                        done.append(row())
                    state = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0, 0]
                for role, text in template.parse(output):
                    state[1] += 1
                    state[2].update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
                for s in spans:
                    if s["role"] in trained and s["text_start"] >= 0:
                        text = template.unescape(output[s["text_start"]:s["text_stop"]])
                        state[3] += len(text)
                        state[4].update(text.encode("utf-8", "surrogatepass"))
                state[5] += len(output)
                state[6] += len(rewrites)
            if done:
                yield batch_of(done)
                done.clear()
        if state is not None:
            yield batch_of([row()])

    return (outputs.repartition("conv_id").sortWithinPartitions("conv_id", "piece").mapInArrow(run, schema))
