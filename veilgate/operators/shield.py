"""Detection and protection of personal data in text columns.

Everything is a Column expression over the input row: no shuffle, no Python in the tasks.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilgate.functions import sqltext
from veilgate.functions.ids import stable_id
from veilgate.functions.patterns import EIGHT_DIGITS, RECOGNISERS, Recogniser, java_regex
from veilgate.functions.rules import RuleSet
from veilgate.operators.keyed import is_small, salted_join
from veilgate.session import settle

SPAN = (
    "struct<neg_width:int,neg_score:double,ord:int,start:int,end:int,"
    "entity_type:string,score:double,original:string>"
)
NO_SPANS = sqltext.empty(SPAN)
BLOCK = 128
# Up to so many matches of a pattern are placed, and so many detections of a text replaced, by plain expressions: Spark
# compiles these, but not folds and lambdas.
PLACED = 3
SLOTS = 6
SURROGATE_REGEX = r"\[[A-Z_]+:[0-9A-F]{8}\]"
RESULT_COLUMNS = (
    "detections",
    "status",
    "blocked_type",
    "safe_text",
    "was_modified",
    "token_map",
)
Detector = Callable[[Column], Column]


def _span(entity: str, start: str, end: str, score: str, order: int, original: str) -> str:
    """SQL text of one span; its leading fields give the order of preference."""
    return (
        f"named_struct('neg_width', ({start}) - ({end}), 'neg_score', -{score}, 'ord', {order}, "
        f"'start', {start}, 'end', {end}, 'entity_type', {entity}, 'score', {score}, "
        f"'original', {original})"
    )


def _start_of_only(text: str, matches: str) -> str:
    """SQL text of where a pattern's only match starts; null if there are more, or if its characters occur elsewhere too."""
    hit = f"get({matches}, 0)"
    first = f"locate({hit}, {text})"
    return f"CASE WHEN size({matches}) = 1 AND locate({hit}, {text}, {first} + 1) = 0 THEN {first} - 1 END"


def _lengths(text: str, order: int, recogniser: Recogniser) -> str:
    """SQL text of the lengths of a pattern's matches, each with what lies between it and the one before; they give the offsets.

    Null where a pattern matches nothing at all, which the search for the next whole would not get past.
    """
    matches, pattern = f"_m{order}", sqltext.raw(rf"(?s)\G.*?(?:(?-s){recogniser.regex})")
    wholes = f"transform(regexp_extract_all({text}, {pattern}, 0), whole -> length(whole))"
    found = f"""CASE WHEN only IS NOT NULL THEN array(only + length(get({matches}, 0)))
        WHEN NOT array_contains({matches}, '') THEN {wholes} END"""
    return f"CASE WHEN size({matches}) > 0 THEN {sqltext.let(_start_of_only(text, matches), 'only', found)} END"


def _located(text: str, recogniser: Recogniser, order: int) -> str:
    """SQL text turning the matches of one pattern into spans.

    A few are placed by the sums of their lengths (``_l``), more by running sums. Where these are not one per match, splitting
    by the same pattern yields the text between the matches.
    """
    matches, lengths = f"_m{order}", f"_l{order}"
    entity, score = sqltext.text(recogniser.entity_type), f"{recogniser.score!r}D"
    span = _span(entity, "run.state + x.gap", "run.state + x.gap + length(x.hit)", score, order, "x.hit")
    steps = f"""CASE WHEN size({lengths}) = size({matches})
        THEN zip_with({lengths}, {matches}, (whole, hit) -> named_struct('gap', whole - length(hit), 'hit', hit))
        ELSE filter(
          zip_with(
            split({text}, {sqltext.raw(recogniser.regex)}, -1), {matches},
            (gap, hit) -> named_struct('gap', length(gap), 'hit', hit)),
          step -> step.hit IS NOT NULL) END"""
    step = (
        "named_struct('state', run.state + x.gap + length(x.hit), "
        f"'out', concat(run.out, array({span})))"
    )
    found = sqltext.gather("steps", "0", SPAN, step, "flatten(whole.parts)", BLOCK)
    placed = []
    for k in range(PLACED):
        hit, stop = f"get({matches}, {k})", " + ".join(f"get({lengths}, {j})" for j in range(k + 1))
        placed.append(f"CASE WHEN size({matches}) > {k} THEN {_span(entity, f'{stop} - length({hit})', stop, score, order, hit)} END")
    return (
        f"CASE WHEN size({matches}) = 0 OR {matches} IS NULL THEN {NO_SPANS} "
        f"WHEN size({matches}) <= {PLACED} AND size({lengths}) = size({matches}) THEN slice(array({', '.join(placed)}), 1, size({matches})) "
        f"ELSE {sqltext.let(steps, 'steps', found)} END"
    )


def _gated(text: str, recogniser: Recogniser) -> str:
    """SQL text of a pattern's matches, behind a cheap test that every match must pass."""
    found = f"regexp_extract_all({text}, {sqltext.raw(recogniser.regex)}, 0)"
    needed = {"digit": "_digit", "digits": "_digits", "at": f"contains({text}, '@')"}.get(recogniser.needs)
    return f"CASE WHEN {needed} THEN {found} END" if needed else found


def _adopted(found: str, rules: RuleSet, order: int) -> str:
    """SQL text of a plugged-in detector's spans, gated by the rule thresholds."""
    span = _span(
        "d.entity_type",
        "CAST(d.start AS INT)",
        "CAST(d.end AS INT)",
        "CAST(d.score AS DOUBLE)",
        order,
        "d.original",
    )
    passing = f"filter({found}, d -> d.score >= {rules.threshold_of('d.entity_type')})"
    return f"coalesce(transform({passing}, d -> {span}), {NO_SPANS})"


# Greedy choice: widest first, then higher score, then detection order. Above FEW spans only those of one run
# of touching spans are compared with each other; runs are cut where a span starts behind all ends.
FEW = 16
_GREEDY = f"""
aggregate({{spans}}, {NO_SPANS},
  (kept, c) -> CASE WHEN exists(kept, k -> k.start < c.end AND k.end > c.start) THEN kept
    ELSE concat(kept, array(c)) END)""".format
_NEXT_RUN = """
CASE WHEN x.start < run.state.end
  THEN named_struct('state', named_struct(
    'end', greatest(run.state.end, x.end), 'spans', concat(run.state.spans, array(x))), 'out', run.out)
  ELSE named_struct('state', named_struct('end', x.end, 'spans', array(x)),
    'out', concat(run.out, array(run.state.spans))) END"""
_RUNS = sqltext.gather(
    "_ordered",
    f"named_struct('end', -1, 'spans', {NO_SPANS})",
    f"array<{SPAN}>",
    _NEXT_RUN,
    "concat(flatten(whole.parts), array(whole.state.spans))",
    BLOCK,
)
BEST = f"CASE WHEN size(_every) <= {FEW} THEN sort_array(_every) END"
ORDERED = f"CASE WHEN size(_every) > {FEW} THEN array_sort(_every, (a, b) -> a.start - b.start) END"
WITHOUT_OVERLAPS = f"""
CASE WHEN size(_every) < 2 THEN _every
  WHEN size(_every) <= {FEW} THEN {_GREEDY(spans="_best")}
  ELSE flatten(transform({_RUNS}, r -> CASE WHEN size(r) < 2 THEN r ELSE {_GREEDY(spans="sort_array(r)")} END)) END"""

RIGHT_TO_LEFT = """
sort_array(transform(_chosen, s -> named_struct(
  'start', s.start, 'end', s.end, 'entity_type', s.entity_type, 'score', s.score,
  'original', s.original)), false)"""


def detect(
    df: DataFrame,
    text: str,
    rules: RuleSet,
    recognisers: Sequence[Recogniser] = RECOGNISERS,
    detectors: Sequence[Detector] = (),
    gate: bool = True,
    resolve: bool = True,
    out: str = "spans",
) -> DataFrame:
    """Add the detected spans of a text column, listed right to left.

    ``gate`` drops detections below the rule thresholds before overlaps are resolved. With
    ``resolve=False`` every detection of every recogniser is returned.
    """
    source = sqltext.name(text)
    active = [
        (i, r)
        for i, r in enumerate(recognisers)
        if not gate or r.score >= rules.threshold(r.entity_type)
    ]
    plugged = {f"_d{n}": detector(F.col(text)) for n, detector in enumerate(detectors)}
    gates = {"_digit": r"\d", "_digits": EIGHT_DIGITS}
    staged = df.withColumns({g: F.expr(f"{source} RLIKE {sqltext.raw(java_regex(p))}") for g, p in gates.items()} | plugged)
    matches = {f"_m{i}": F.expr(_gated(source, r)) for i, r in active}
    staged = staged.withColumns(matches) if matches else staged
    lengths = {f"_l{i}": F.expr(_lengths(source, i, r)) for i, r in active}
    staged = staged.withColumns(lengths) if lengths else staged
    found = [_located(source, r, i) for i, r in active]
    found += [_adopted(d, rules, len(recognisers) + n) for n, d in enumerate(plugged)]
    every = f"concat({', '.join(found)})" if found else NO_SPANS
    ranked = staged.withColumn("_every", F.expr(every)).withColumn("_ordered", F.expr(ORDERED)).withColumn("_best", F.expr(BEST))
    ranked = ranked.withColumn("_chosen", F.expr(WITHOUT_OVERLAPS if resolve else "_every")).withColumn("_found", F.expr(RIGHT_TO_LEFT))
    kept = [c for c in df.columns if c != out]
    return ranked.select(*kept, evaluated_once(F.col("_found")).alias(out))


def _rewritten(source: str) -> str:
    """SQL text of the source with the ``_rising`` detections replaced.

    Blocks of detections cut their stretch out of the text first, so no step copies the whole text.
    """
    at = f"CAST(number * {BLOCK} AS INT)"
    before = f"CASE WHEN {at} = 0 THEN 0 ELSE element_at(_rising, {at}).end END"
    last = f"least(({at}) + {BLOCK}, size(_rising))"
    stretch = f"substring({source}, start + 1, element_at(_rising, {last}).end - start)"
    gap = "CASE WHEN i = 0 THEN start ELSE element_at(block, i).end END"
    pieces = f"""array_join(transform(block, (d, i) -> {sqltext.let(
        gap, "previous",
        "concat(substring(stretch, previous - start + 1, d.start - previous), d.replacement)")}), '')"""
    whole = sqltext.let(
        before,
        "start",
        sqltext.let(stretch, "stretch", sqltext.let(f"slice(_rising, {at} + 1, {BLOCK})", "block", pieces)),
    )
    blocks = f"transform(sequence(0, (size(_rising) - 1) div {BLOCK}), number -> {whole})"
    tail = f"substring({source}, element_at(_rising, -1).end + 1)"
    return f"concat(array_join({blocks}, ''), {tail})"


def _rewritten_few(source: str) -> str:
    """SQL text of the source with up to SLOTS detections replaced, without folds."""
    pieces = [f"substring({source}, 1, element_at(detections, -1).start)"]
    for i in reversed(range(SLOTS)):
        this = f"get(detections, {i})"
        rest = f", get(detections, {i - 1}).start - {this}.end" if i else ""
        pieces.append(
            f"CASE WHEN size(detections) > {i} THEN concat({this}.replacement, substring({source}, {this}.end + 1{rest})) ELSE '' END"
        )
    return f"concat({', '.join(pieces)})"


def evaluated_once(value: Column) -> Column:
    """A generator of one row around a costly value.

    Filters on the result stay above it; pushed below, they would repeat the whole expression.
    """
    return F.explode(F.array(value))


def shield(
    df: DataFrame,
    text: str,
    rules: RuleSet,
    role: str | None = None,
    recognisers: Sequence[Recogniser] = RECOGNISERS,
    detectors: Sequence[Detector] = (),
    scope: str | None = None,
    on_block: str = "quarantine",
) -> DataFrame:
    """Detect, resolve and protect one text column; ``role`` and ``scope`` name columns.

    Adds ``detections`` (right to left, with replacement and applied mode), ``status``
    (``ok``/``blocked``), ``blocked_type`` (the right-most blocked entity), ``safe_text`` (null
    when blocked), ``was_modified`` and ``token_map``. ``on_block`` keeps blocked rows
    (``quarantine``), removes them (``drop``) or fails the job (``fail``).
    """
    if on_block not in ("quarantine", "drop", "fail"):
        raise ValueError(f"unknown on_block {on_block!r}")
    source = sqltext.name(text)

    def protection(d: str) -> str:
        mode = rules.mode_of(f"{d}.entity_type")
        exempt = f"array_contains(_exempt, {d}.entity_type)"
        hashed = f"{d}.original"
        if scope is not None:
            hashed = f"concat_ws(':', {sqltext.name(scope)}, {d}.entity_type, {d}.original)"
        return f"""named_struct(
          'entity_type', {d}.entity_type, 'start', {d}.start, 'end', {d}.end, 'score', {d}.score,
          'original', {d}.original,
          'replacement', CASE
            WHEN {exempt} THEN {d}.original
            WHEN {mode} = 'token' THEN
              concat('[', {d}.entity_type, ':', upper(substring(sha2({hashed}, 256), 1, 8)), ']')
            ELSE concat('[', {d}.entity_type, ']') END,
          'mode', CASE WHEN {exempt} THEN 'mask' ELSE {mode} END)"""

    few = ", ".join(f"CASE WHEN size(spans) > {i} THEN {protection(f'get(spans, {i})')} END" for i in range(SLOTS))
    detections = (
        f"CASE WHEN size(spans) <= {SLOTS} THEN slice(array({few}), 1, size(spans)) "
        f"ELSE transform(spans, d -> {protection('d')}) END"
    )
    # Within a text where two originals share a token, the map keeps the left-most; the vault keeps both.
    token_map = """
    CASE WHEN status = 'blocked' OR size(_tokens) = 0
      THEN CAST(map() AS map<string,string>)
      WHEN size(array_distinct(_tokens.replacement)) = size(_pairs) THEN map_from_entries(_pairs)
      ELSE map_from_arrays(
        array_distinct(_tokens.replacement),
        transform(array_distinct(_tokens.replacement),
          t -> element_at(filter(_tokens, d -> d.replacement = t), -1).original)) END"""
    # Only the detections are held by a generator: what is derived from them is left out where nobody reads it.
    found = (
        detect(df, text, rules, recognisers, detectors)
        .withColumn("_exempt", F.expr(rules.exempt_types(sqltext.name(role) if role else None)))
        .withColumn("_protected", F.expr(detections))
    )
    kept = [F.col(c) for c in df.columns if c not in RESULT_COLUMNS or c == text]
    protected = (
        found.select(*kept, evaluated_once(F.col("_protected")).alias("detections"))
        .withColumn("_blocked", F.expr("CAST(array_position(detections.mode, 'block') AS INT)"))
        .withColumn("_rising", F.expr("reverse(detections)"))
        .withColumns(
            {
                "status": F.expr("CASE WHEN _blocked > 0 THEN 'blocked' ELSE 'ok' END"),
                "blocked_type": F.expr("get(detections.entity_type, _blocked - 1)"),
                "safe_text": F.expr(
                    f"CASE WHEN _blocked = 0 THEN CASE WHEN size(detections) = 0 THEN {source} "
                    f"WHEN size(detections) <= {SLOTS} THEN {_rewritten_few(source)} ELSE {_rewritten(source)} END END"
                ),
                "_tokens": F.expr("filter(detections, d -> d.mode = 'token')"),
            }
        )
        .withColumn(
            "_pairs",
            F.expr(
                "array_distinct(transform(_tokens, "
                "d -> named_struct('token', d.replacement, 'original', d.original)))"
            ),
        )
        .withColumns(
            {
                "was_modified": F.expr(f"coalesce(safe_text <> {source}, false)"),
                "token_map": F.expr(token_map),
            }
        )
    )
    protected = protected.select(*[c for c in df.columns if c not in RESULT_COLUMNS], *RESULT_COLUMNS)
    if on_block == "drop":
        return protected.where("status = 'ok'")
    if on_block == "fail":
        stop = "CAST(raise_error(concat('blocked entity: ', blocked_type)) AS STRING)"
        return protected.withColumn(
            "status", F.expr(f"CASE WHEN status = 'blocked' THEN {stop} ELSE 'ok' END")
        )
    return protected


# -- results derived from shielded rows -----------------------------------------------------------


def entity_types(detections: Column) -> Column:
    return F.transform(detections, lambda d: d["entity_type"])


def modes(detections: Column) -> Column:
    return F.transform(detections, lambda d: d["mode"])


def classify(detections: Column) -> Column:
    """Sorted distinct entity types, the classification stored next to a chunk."""
    return F.array_sort(F.array_distinct(entity_types(detections)))


def violations(shielded: DataFrame, key: str, agent: str | None = None) -> DataFrame:
    """One record per blocked text; carries identifiers only, never text."""
    agent_id = F.col(agent) if agent else F.lit("")
    return shielded.where(F.col("status") == "blocked").select(
        F.col(key),
        agent_id.alias("agent_id"),
        F.array("blocked_type").alias("entity_types"),
        stable_id(F.col(key), F.col("blocked_type")).alias("violation_id"),
    )


def vault(shielded: DataFrame) -> DataFrame:
    """All distinct (token, original) pairs; to be stored apart from any safe text.

    A token is a hash of 32 bits, so two originals may share one: both are kept.
    """
    return (
        shielded.where((F.col("status") == "ok") & F.exists("detections", lambda d: d["mode"] == "token"))
        .select(F.explode(F.filter("detections", lambda d: d["mode"] == "token")).alias("d"))
        .select(F.col("d.replacement").alias("token"), F.col("d.original").alias("original"))
        .distinct()
    )


def detokenize(df: DataFrame, key: str, text: str, vault_table: DataFrame) -> DataFrame:
    """Put the originals back, for authorised use only.

    Adds ``restored_text`` and ``ambiguous_tokens``: tokens with several originals in the vault are left
    in the text and listed, for nobody can tell whose value they stand for. The vault is written once, as
    a table of one row per token; its tokens are broadcast when it is small, otherwise a salted join meets
    the distinct tokens of each text, since one token may occur in most texts.
    """
    known_tokens = settle(
        vault_table.groupBy("token").agg(
            F.min("original").alias("original"), (F.min("original") < F.max("original")).alias("ambiguous")
        ),
        "vault",
    )
    tokens = df.select(
        key,
        F.explode(
            F.array_distinct(F.regexp_extract_all(F.col(text), F.lit(SURROGATE_REGEX), F.lit(0)))
        ).alias("token"),
    )
    if is_small(known_tokens):
        known = tokens.join(F.broadcast(known_tokens), "token")
    else:
        known = salted_join(tokens, known_tokens, ["token"], spread=[key])
    per_text = known.groupBy(key).agg(
        F.sort_array(F.collect_list(F.struct("token", "original", "ambiguous"))).alias("_known")
    )
    restored = F.expr(
        f"CASE WHEN _known IS NULL THEN {sqltext.name(text)} ELSE aggregate("
        f"filter(_known, p -> NOT p.ambiguous), "
        f"{sqltext.name(text)}, (t, p) -> replace(t, p.token, p.original)) END"
    )
    ambiguous = F.expr(
        "coalesce(transform(filter(_known, p -> p.ambiguous), p -> p.token), CAST(array() AS array<string>))"
    )
    joined = df.join(per_text, key, "left")
    return joined.withColumns({"restored_text": restored, "ambiguous_tokens": ambiguous}).drop("_known")


def token_cross_reference(shielded: DataFrame, key: str) -> DataFrame:
    """How often and in how many texts each token occurs."""
    occurrences = shielded.where(F.col("status") == "ok").select(
        key, F.explode(F.filter("detections", lambda d: d["mode"] == "token")).alias("d")
    )
    per_text = occurrences.groupBy(F.col("d.replacement").alias("token"), key).agg(
        F.count(F.lit(1)).alias("n")
    )
    return per_text.groupBy("token").agg(
        F.sum("n").alias("occurrences"), F.count(F.lit(1)).alias("texts")
    )


def audit_events(
    shielded: DataFrame, key: str, agent: str, context: Column, at: Column, rules: RuleSet | None = None
) -> DataFrame:
    """One metadata-only event per text with detections; blocked texts emit none, nor does any where ``rules`` say so."""
    wanted = F.lit(rules is None or rules.audit_all_events)
    return shielded.where(wanted & (F.size("detections") > 0) & (F.col("status") != "blocked")).select(
        stable_id(F.lit("PII_PROCESSED"), F.col(key)).alias("event_id"),
        F.lit("PII_PROCESSED").alias("event_type"),
        F.col(agent).alias("agent_id"),
        context.alias("context_id"),
        at.alias("timestamp"),
        F.lit("INFO").alias("severity"),
        entity_types(F.col("detections")).alias("entity_types"),
        modes(F.col("detections")).alias("modes_applied"),
        F.col("was_modified"),
    )


def threshold_sweep(
    df: DataFrame, text: str, label: str, rules: RuleSet, thresholds: Sequence[float]
) -> DataFrame:
    """Detections and texts hit per entity type, label value and candidate threshold."""
    found = detect(df, text, rules, gate=False, resolve=False)
    kinds = F.array_distinct(
        F.transform("spans", lambda s: F.struct(s["entity_type"], s["score"]))
    )
    counted = found.select(label, "spans", F.explode(kinds).alias("kind")).select(
        label,
        F.col("kind.entity_type").alias("entity_type"),
        F.col("kind.score").alias("score"),
        F.size(
            F.filter(
                "spans",
                lambda s: (s["entity_type"] == F.col("kind.entity_type"))
                & (s["score"] == F.col("kind.score")),
            )
        ).alias("n"),
    )
    levels = F.array(*[F.lit(float(t)) for t in thresholds])
    return (
        counted.withColumn("threshold", F.explode(levels))
        .where(F.col("score") >= F.col("threshold"))
        .groupBy("entity_type", label, "threshold")
        .agg(F.sum("n").alias("detections"), F.count(F.lit(1)).alias("texts"))
    )


def threshold_quality(
    labelled: DataFrame, text: str, truth: str, rules: RuleSet, thresholds: Sequence[float]
) -> DataFrame:
    """Precision and recall per threshold against a column of true entity types per text."""
    found = detect(labelled, text, rules, gate=False, resolve=False)
    levels = F.array(*[F.lit(float(t)) for t in thresholds])
    scored = (
        found.withColumn("threshold", F.explode(levels))
        .withColumn(
            "hits",
            F.array_distinct(
                F.transform(
                    F.filter("spans", lambda s: s["score"] >= F.col("threshold")),
                    lambda s: s["entity_type"],
                )
            ),
        )
        .withColumn("right", F.size(F.array_intersect("hits", truth)))
    )
    return (
        scored.groupBy("threshold")
        .agg(
            F.sum("right").alias("true_positives"),
            F.sum(F.size("hits")).alias("reported"),
            F.sum(F.size(truth)).alias("expected"),
        )
        .withColumn("precision", F.try_divide("true_positives", "reported"))
        .withColumn("recall", F.try_divide("true_positives", "expected"))
    )


def split_entities(
    chunks: DataFrame, document: str, position: str, text: str, rules: RuleSet
) -> DataFrame:
    """Entities that chunk borders cut, over however many chunks they reach.

    The chunks of a document are put together, as they were before it was cut; entities are found in the
    whole and those that begin and end in different chunks are returned with both positions. What is
    gathered is one document, never more. Null chunks count as empty.
    """
    pieces = chunks.groupBy(document).agg(
        F.sort_array(F.collect_list(F.struct(F.col(position).alias("at"), F.coalesce(text, F.lit("")).alias("piece")))).alias(
            "_pieces"
        )
    )
    starts = sqltext.gather(
        "_pieces",
        "0",
        "int",
        "named_struct('state', run.state + length(x.piece) + 1, 'out', concat(run.out, array(run.state)))",
        "flatten(whole.parts)",
        BLOCK,
    )
    whole = pieces.withColumns(
        {"_whole": F.array_join(F.col("_pieces.piece"), " "), "_starts": F.expr(starts)}
    )
    chunk_of = "element_at(_pieces, size(filter(_starts, b -> b {}))).at"
    found = detect(whole, "_whole", rules).select(
        document, "_pieces", "_starts", F.explode("spans").alias("s")
    )
    return (
        found.withColumns(
            {
                position: F.expr(chunk_of.format("<= s.start")),
                f"last_{position}": F.expr(chunk_of.format("< s.end")),
            }
        )
        .where(F.col(position) < F.col(f"last_{position}"))
        .select(
            document,
            position,
            f"last_{position}",
            F.col("s.entity_type").alias("entity_type"),
            F.length("s.original").alias("length"),
        )
    )
