"""Chat formatting: conversations rendered through a compiled template, and read back from the formatted text."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import text_of
from quire.llm.template import compile_template

#: A turn is <s>role, newline, text, </s>, newline; a user's text stands between [INST] marks.
TEMPLATE = r"""
{%- for message in messages -%}
{{ '<s>' + message.role | role + '\n' }}
{%- if message.role == 'user' -%}
{{ '[INST] ' + message.text | escape + ' [/INST]' }}
{%- elif message.role == 'assistant' -%}
{% generation %}{{ message.text | escape }}{% endgeneration %}
{%- else -%}
{{ message.text | escape }}
{%- endif -%}
{{ '</s>' + '\n' }}
{%- endfor -%}
"""
#: Control strings, with the backslashes that hide them in texts after their first character.
CONTROL = re.compile(r"([<\[])(\\*)(/?s>|/?INST\])")
HIDDEN = re.compile(r"([<\[])\\(\\*)(/?s>|/?INST\])")
TURN = re.compile(r"<s>([^\n]*)\n(.*?)</s>\n", re.S)
#: A formatted part is closed once it holds so many code points.
PART_CHARS = 1 << 20


def escape(text: str) -> str:
    """Hide control strings: each gets one more backslash after its first character."""
    return CONTROL.sub(r"\1\\\2\3", text or "")


def unescape(text: str) -> str:
    return HIDDEN.sub(r"\1\2\3", text)


def role_name(role: str) -> str:
    """A role as it stands in a turn's first line; letters and digits of ASCII and _.-~ are kept as they are."""
    return quote(role or "", safe="")


def chat_template(source: str = TEMPLATE):
    return compile_template(source, {"escape": escape, "role": role_name})


def read_turns(formatted: str) -> Iterator[tuple[str, str]]:
    """(role, text) of each turn of a text that the default template has made."""
    at = 0
    for m in TURN.finditer(formatted):
        if m.start() != at:
            raise ValueError(f"no turn at {at}")
        at, role, text = m.end(), unquote(m[1]), m[2]
        yield role, unescape(text.removeprefix("[INST] ").removesuffix(" [/INST]") if role == "user" else text)
    if at != len(formatted):
        raise ValueError(f"no turn at {at}")


def format_conversations(rows: DataFrame, source: str = TEMPLATE, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Rows (conv, worker, part, edge, formatted, starts, ends): each conversation's formatted text in one or more
    parts, in the order (worker, part), with the spans under the loss mask in code points of the part.

    Turns are taken in the order of turn, role, text (nulls first); null roles and texts count as empty, rows with a
    null conversation id form one conversation, repeated rows are repeated turns. The turns are dealt out by ranges
    of (conversation, turn), so that one conversation with a third of all rows is spread over many tasks; ``edge``
    marks conversations that may go on in a neighbouring task. The template must render each turn by itself.
    An empty table gives no rows.
    """
    spark = rows.sparkSession
    picked = rows.select(F.col(conv_col).alias("__c"), F.col(turn_col).alias("__t"), F.coalesce(F.col(role_col).cast("string"), F.lit("")).alias("role"), text_of(text_col).alias("text"))
    keys = ["__c", "__t", "role"]
    # the beginning of the text sorts as the text does, and keeps equal turns (null ones, say) out of one task
    dealt = picked.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *keys, F.substring("text", 1, 64)).sortWithinPartitions(*keys, "text")

    def render(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        template, worker, part = chat_template(source), TaskContext.get().partitionId(), 0
        seen, out, spans, size, conv, split = 0, [], [], 0, None, False

        def close(last: bool) -> pd.DataFrame:
            return pd.DataFrame({"conv": [conv], "worker": [worker], "part": [part], "edge": [seen == 1 or last or split], "formatted": ["".join(out)], "starts": [[a for a, _ in spans]], "ends": [[b for _, b in spans]]})

        for batch in batches:
            done = []
            for c, role, text in zip(batch["conv"], batch["role"], batch["text"], strict=True):
                if not seen or c != conv or size >= PART_CHARS:
                    if out:
                        split |= size >= PART_CHARS
                        done.append(close(False))
                    if not seen or c != conv:
                        seen, split = seen + 1, False
                    part += 1
                    out, spans, size, conv = [], [], 0, c
                made, own = template.render(messages=[{"role": role, "text": text}])
                out.append(made)
                spans += [(a + size, b + size) for a, b in own]
                size += len(made)
            if done:
                yield pd.concat(done)
        if out:
            yield close(True)

    strung = dealt.select(F.col("__c").cast("string").alias("conv"), "role", "text")
    return strung.mapInPandas(render, "conv string, worker int, part long, edge boolean, formatted string, starts array<long>, ends array<long>")


def digest_conversations(parts: DataFrame) -> DataFrame:
    """Per conversation, read back from its formatted parts: numbers of turns and characters, and digests.

    A conversation that lies within one task is digested there. For one that spans tasks the parts' own text goes to
    the task that chains the digest: a digest over a whole conversation is defined one byte after another, so this
    step is a stream of constant memory; rendering and reading back are done before it, in parallel.
    """

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for conv, worker, part, edge, formatted, starts, ends in batch.itertuples(index=False, name=None):
                turns = list(read_turns(formatted))
                said = "".join(f"{r}\n{t}\n" for r, t in turns).encode("utf-8")
                loss = "".join(unescape(formatted[a:b]) for a, b in zip(starts, ends, strict=True))
                n, m = len(loss), loss.encode("utf-8")
                if edge:
                    rows.append((conv, worker, part, len(turns), n, len(formatted), None, None, said, m))
                else:
                    rows.append((conv, worker, part, len(turns), n, len(formatted), hashlib.sha256(said).hexdigest(), hashlib.sha256(m).hexdigest(), None, None))
            yield pd.DataFrame(rows, columns=["conv", "worker", "part", "n_turns", "loss_chars", "formatted_chars", "turns_sha256", "loss_sha256", "said", "loss"])

    def chain(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = ["conv", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        begun, conv, counts, said, loss = False, None, [0, 0, 0], hashlib.sha256(), hashlib.sha256()
        for batch in batches:
            done = []
            for c, _, _, *more, said_all, loss_all, a, b in batch.itertuples(index=False, name=None):
                if begun and c != conv:
                    done.append((conv, counts[0], said.hexdigest(), counts[1], loss.hexdigest(), counts[2]))
                    begun = False
                if said_all is not None:
                    done.append((c, more[0], said_all, more[1], loss_all, more[2]))
                    continue
                if not begun:
                    begun, conv, counts, said, loss = True, c, [0, 0, 0], hashlib.sha256(), hashlib.sha256()
                counts = [x + y for x, y in zip(counts, more, strict=True)]
                said.update(a)
                loss.update(b)
            yield pd.DataFrame(done, columns=columns)
        if begun:
            yield pd.DataFrame([(conv, counts[0], said.hexdigest(), counts[1], loss.hexdigest(), counts[2])], columns=columns)

    pieces = parts.mapInPandas(read, "conv string, worker int, part long, n_turns long, loss_chars long, formatted_chars long, turns_sha256 string, loss_sha256 string, said binary, loss binary")
    return (
        pieces.repartition(int(parts.sparkSession.conf.get("spark.sql.shuffle.partitions")), "conv")
        .sortWithinPartitions("conv", "worker", "part")
        .mapInPandas(chain, "conv string, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
    )


SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]')
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(9 + length(role) + CASE WHEN role = 'user' THEN 15 ELSE 0 END
           + length(regexp_replace(text, '([<\[])(\\*)(/?s>|/?INST\])', '\1\\\2\3', 'g'))) AS BIGINT) AS formatted_chars
FROM c GROUP BY conv_id
"""
