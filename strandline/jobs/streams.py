"""Jobs over ordered dataflow operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandline.functions import seq
from strandline.operators import streams as S
from strandline.sources.tables import table

from .common import DNA, reference

GROUP, ORDER = ["user_id"], ["ts", "event_id"]


def _events(spark, d):
    return table(spark, d, "events").select("event_id", "ts", "user_id", "event_type", "value")


def pipe_filter(spark, d):
    return _events(spark, d).select("event_id", (F.col("value") * 2).alias("doubled"), F.upper("event_type").alias("kind"), F.col("event_id").cast("string").alias("as_text"))


def pipe_counter(spark, d):
    return S.counter(_events(spark, d), "ts", "event_id").select("event_id", "ord")


def pipe_namer(spark, d):
    return S.namer(_events(spark, d), "user_id").select("event_id", "name_id")


def pipe_joiner(spark, d):
    left = S.counter(_events(spark, d), "event_id").select("ord", "event_id")
    right = S.counter(table(spark, d, "conversations").select("conv_id", "turn"), "conv_id", "turn")
    return S.joiner(left, right).select("ord", "event_id", "conv_id", "turn")


def pipe_joiner3(spark, d):
    """Three streams side by side, as long as the shortest."""
    events = S.counter(_events(spark, d), "event_id").select("ord", "event_id")
    turns = S.counter(table(spark, d, "conversations").select("conv_id", "turn"), "conv_id", "turn")
    pages = S.counter(table(spark, d, "pages").select("page_id"), "page_id")
    return S.joiner(events, turns, pages).select("ord", "event_id", "conv_id", "turn", "page_id")


def pipe_shifter(spark, d):
    return S.shifter(_events(spark, d), "event_type", 2, GROUP, ORDER, blank="-").select("event_id", "shifted")


def pipe_echoer(spark, d):
    e = S.echoer(_events(spark, d), "event_type", 3, GROUP, ORDER)
    return e.select("event_id", F.concat_ws("|", "echo").alias("echo"))


def pipe_tupler(spark, d):
    t = S.tupler(_events(spark, d), "event_type", 3, GROUP, ORDER)
    return t.select("event_id", F.concat_ws("|", "tuple").alias("tuple"))


def pipe_sampler_dc7(spark, d):
    """Seven-tuples at the positions 1, 2, 4 modulo 7 from the end of each user's stream."""
    t = S.sampler(_events(spark, d), "event_type", 7, (1, 2, 4), GROUP, ORDER)
    return t.select("event_id", "from_end", F.concat_ws("|", "tuple").alias("tuple"))


def pipe_mapper(spark, d):
    """Each user's stream turned round: the new ordinal is the number of later rows."""
    rows = S.placed(_events(spark, d), GROUP, ORDER, "ord", "left")
    return S.mapper(rows, F.col("left") - 1).select("event_id", "ord")


def pipe_sorter(spark, d):
    return S.counter(_events(spark, d), "value", "event_id", name="place").select("event_id", "place")


def global_starts(spark, d):
    """Where each document's DNA starts in the concatenation of all."""
    sized = reference(spark, d).select("seq_id", F.length("dna").cast("long").alias("n"))
    return S.global_starts(sized, "n", "seq_id")


def pos_localize(spark, d):
    """Document and offset of every position of the concatenation."""
    return S.localized(global_starts(spark, d), "seq_id", "n")


def _names(spark, d):
    return table(spark, d, "part").select("p_partkey", seq.normalize(F.col("p_name"), "keep_upper").alias("dna"))


def pipe_hamming_env(spark, d):
    return S.hamming_environment(_names(spark, d), "dna", "ACGT", "p_partkey")


def pipe_edit_env(spark, d):
    return S.edit_environment(_names(spark, d), "dna", "ACGT", "p_partkey")


W = "OVER (PARTITION BY user_id ORDER BY ts, event_id)"
_NAMES = "n AS (SELECT p_partkey, regexp_replace(upper(p_name), '[^ACGT]', '', 'g') AS dna FROM part), l AS (SELECT unnest(['A', 'C', 'G', 'T']) AS x)"
_HAMMING = "SELECT p_partkey, dna AS variant FROM n UNION ALL SELECT p_partkey, left(dna, i - 1) || x || substr(dna, i + 1) FROM (SELECT p_partkey, dna, unnest(range(1, length(dna) + 1)) AS i FROM n) q, l WHERE substr(dna, i, 1) <> x"
JOBS = {
    "pipe_filter": (pipe_filter, "SELECT event_id, value * 2 AS doubled, upper(event_type) AS kind, event_id::VARCHAR AS as_text FROM events"),
    "pipe_counter": (pipe_counter, "SELECT event_id, row_number() OVER (ORDER BY ts, event_id) - 1 AS ord FROM events"),
    "pipe_namer": (pipe_namer, "SELECT event_id, dense_rank() OVER (ORDER BY user_id) - 1 AS name_id FROM events"),
    "pipe_joiner": (pipe_joiner, "WITH a AS (SELECT row_number() OVER (ORDER BY event_id) - 1 AS ord, event_id FROM events), b AS (SELECT row_number() OVER (ORDER BY conv_id, turn) - 1 AS ord, conv_id, turn FROM conversations) SELECT ord, event_id, conv_id, turn FROM a JOIN b USING (ord)"),
    "pipe_joiner3": (pipe_joiner3, "WITH a AS (SELECT row_number() OVER (ORDER BY event_id) - 1 AS ord, event_id FROM events), b AS (SELECT row_number() OVER (ORDER BY conv_id, turn) - 1 AS ord, conv_id, turn FROM conversations), c AS (SELECT row_number() OVER (ORDER BY page_id) - 1 AS ord, page_id FROM pages) SELECT ord, event_id, conv_id, turn, page_id FROM a JOIN b USING (ord) JOIN c USING (ord)"),
    "pipe_shifter": (pipe_shifter, f"SELECT event_id, lead(event_type, 2, '-') {W} AS shifted FROM events"),
    "pipe_echoer": (pipe_echoer, f"SELECT event_id, echo FROM (SELECT event_id, event_type || '|' || lag(event_type, 1) {W} || '|' || lag(event_type, 2) {W} AS echo FROM events) WHERE echo IS NOT NULL"),
    "pipe_tupler": (pipe_tupler, f"SELECT event_id, tuple FROM (SELECT event_id, event_type || '|' || lead(event_type, 1) {W} || '|' || lead(event_type, 2) {W} AS tuple FROM events) WHERE tuple IS NOT NULL"),
    "pipe_sampler_dc7": (pipe_sampler_dc7, f"WITH s AS (SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS from_end, concat_ws('|', event_type, {', '.join(f'lead(event_type, {i}) {W}' for i in range(1, 7))}) AS tuple FROM events) SELECT * FROM s WHERE from_end % 7 IN (1, 2, 4)"),
    "pipe_mapper": (pipe_mapper, "SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) - 1 AS ord FROM events"),
    "pipe_sorter": (pipe_sorter, "SELECT event_id, row_number() OVER (ORDER BY value ASC NULLS FIRST, event_id) - 1 AS place FROM events"),
    "global_starts": (global_starts, f"WITH {DNA} SELECT seq_id, length(dna) AS n, coalesce(sum(length(dna)) OVER (ORDER BY seq_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM reference"),
    "pos_localize": (pos_localize, f"WITH {DNA}, s AS (SELECT seq_id, length(dna) AS n, coalesce(sum(length(dna)) OVER (ORDER BY seq_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM reference), e AS (SELECT seq_id, start, unnest(range(0, n)) AS off FROM s) SELECT start + off AS pos, seq_id, off FROM e"),
    "pipe_hamming_env": (pipe_hamming_env, f"WITH {_NAMES} {_HAMMING}"),
    "pipe_edit_env": (pipe_edit_env, f"WITH {_NAMES} SELECT DISTINCT p_partkey, variant FROM ({_HAMMING} UNION ALL SELECT p_partkey, left(dna, i - 1) || substr(dna, i + 1) FROM (SELECT p_partkey, dna, unnest(range(1, length(dna) + 1)) AS i FROM n) UNION ALL SELECT p_partkey, left(dna, i) || x || substr(dna, i + 1) FROM (SELECT p_partkey, dna, unnest(range(0, length(dna) + 1)) AS i FROM n) q, l)"),
}
