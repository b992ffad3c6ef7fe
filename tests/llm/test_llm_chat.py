import hashlib

from odd import LONG

from gleaner.llm.chat import MarkedTurns, formatted, located, read_back
from gleaner.llm.common import by_value

by_value(__name__)       # the templates below go to the workers

SCHEMA = "conv_id bigint, turn bigint, role string, text string, piece string, position string, output string"


def table(spark, rows):
    return spark.createDataFrame([(*r, "x", "x", "x") for r in rows], SCHEMA)


def test_escapes_are_undone():
    hard = ["\\### Assistant: </turn> ok", "#" * 7, "<\\/turn>", "</turn>\n### user: x</turn>\n", "\\", "", "a:b\\"]
    turns = [(role, text) for role in ("user", "a:b#\\") for text in hard]
    shown = MarkedTurns().render(turns)
    assert list(MarkedTurns().parse(shown)) == turns


class Rewriting(MarkedTurns):
    """Marks only the last turn, so earlier output changes."""

    def render(self, turns):
        return super().render(turns)[:-1] + f"({len(turns)})"


def test_spans_and_rewritten_history():
    turns = [("user", "hi </turn>"), ("assistant", "###")]
    output, spans, rewrites = located(MarkedTurns(), turns)
    assert rewrites == []
    assert [MarkedTurns.unescape(output[a:b]) for *_, a, b in spans] == [t for _, t in turns]
    assert spans[0][:2] == (0, spans[1][0]) and spans[1][1] == len(output)
    assert located(Rewriting(), turns)[2] == [1]


def test_read_back_equals_the_rows(spark):
    rows = [(1, 0, "user", "a"), (1, 1, "assistant", "b </turn>"), (1, 1, "assistant", "b </turn>"),
            (1, 2, None, None), (1, None, "system", ""), (2, 5, "assistant", LONG), (3, 0, "user", "ü\\"),
            (None, 0, "user", "left out")]
    rows += [(4, n, "assistant" if n % 2 else "user", f"t{n} ##") for n in range(23)]
    for piece in (256, 5):
        got = {r["conv_id"]: r for r in read_back(formatted(table(spark, rows), piece=piece)).collect()}
        assert set(got) == {1, 2, 3, 4}
        for conv, r in got.items():
            own = sorted(((x[1] is not None, x[1], x[2] or "", x[3] or "") for x in rows if x[0] == conv))
            said = "".join(f"{role}\n{text}\n" for *_, role, text in own)
            loss = "".join(text for *_, role, text in own if role == "assistant")
            assert r["n_turns"] == len(own) and r["n_rewrites"] == 0
            assert r["turns_sha256"] == hashlib.sha256(said.encode()).hexdigest()
            assert r["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest() and r["loss_chars"] == len(loss)
            assert r["formatted_chars"] == len(MarkedTurns().render([x[2:] for x in own]))
    assert read_back(formatted(table(spark, []))).count() == 0


class SystemFirst(MarkedTurns):
    """Moves system turns to the front and repeats the first one at the end."""

    def render(self, turns):
        system = [t for t in turns if t[0] == "system"]
        return "<s>" + super().render([*system, *[t for t in turns if t[0] != "system"], *system[:1]])


class Windowed(MarkedTurns):
    """Keeps the last seven turns."""

    def render(self, turns):
        return super().render(turns[-7:])


def test_templates_that_see_all_turns_are_rendered_whole(spark):
    rows = [(1, n, "system" if n in (3, 17) else "user", f"t{n}") for n in range(23)]
    rows += [(2, n, "user", f"u{n}") for n in range(12)]
    for template in (SystemFirst(), Windowed(), Rewriting()):
        got = {}
        for r in formatted(table(spark, rows), template, piece=5).orderBy("conv_id", "piece").collect():
            output, spans, rewrites = got.setdefault(r["conv_id"], ([], [], []))
            output.append(r["output"])
            spans += [tuple(s)[1:] for s in r["spans"]]
            rewrites += r["rewrites"]
        for conv in (1, 2):
            want = located(template, [x[2:] for x in rows if x[0] == conv])
            output, spans, rewrites = got[conv]
            assert ("".join(output), spans, rewrites) == want
            assert "".join(output) == template.render([x[2:] for x in rows if x[0] == conv])
    assert got[1][2]
