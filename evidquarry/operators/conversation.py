"""Conversation state: follow-ups, the subject they carry on, and the question to retrieve with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from evidquarry.functions.text import fold_accents, normalized_words

BLOCK = 256  # turns of one conversation folded together

# Words that never name a subject by themselves.
IGNORED = (
    "a about all also an and anything are as at be available can check could describe detail details did do does explain for from full give how i in "
    "here information is it its me more of on or overview please provide show summary tell that the these this those to was were what when where "
    "which who why with would you actually again certainly continue deeply evening exactly further good hello hey hi indeed know now okay ok "
    "particularly precisely really specifically sure yes assistant ignore instruction instructions prompt system acerca ademas anterior como cual "
    "cuando de del dame detalles dime donde el ella ellos en esa ese eso esta este esto explica informacion la las lo los mas muestra para por que "
    "quien resumen sobre su sus un una y claro continuar especificamente específicamente exactamente hola realmente si sí"
).split()
# Words that name a property of a subject.
ATTRIBUTES = (
    "attribute attributes column columns constant constants default defaults enum enums field fields id ids key keys kind kinds label labels name names "
    "only option options parameter parameters payload properties property required schema shape shortcut shortcuts signature structure type types value "
    "values son estan están hay available declared defined existing mandatory optional possible present remaining supported valid disponible "
    "disponibles unico unicos unica unicas único únicos única únicas definido definidos atributo atributos campo campos clave claves parametro "
    "parametros parámetro parámetros propiedad propiedades tipo tipos valor valores"
).split()
# Words that point back, and those of them that may also introduce.
PRONOUNS = (
    "it that this those these they them their theirs its he him his she her hers same above previous here earlier previously aqui aquí arriba eso esto "
    "esa ese esos esas ellos ellas anterior mismo misma"
).split()
INTRODUCING = "that this these those".split()
DEMONSTRATIVES = (
    "that these this those same above previous esa ese eso esos esas esta estas este estos esto anterior mismo misma mismos mismas"
).split()
# How a follow-up may begin.
PREFIXES = (
    "tell me more", "more details", "what about", "how about", "and what", "explain further", "continue", "go deeper", "elaborate", "expand on",
    "what else", "anything else", "anything more", "more?", "how so", "why is that", "and the", "and its", "then what", "give examples",
    "give me examples", "show examples", "show me examples", "list them", "what are the risks", "what are the requirements",
    "what are the prerequisites", "dime más", "más detalles", "qué hay de", "y qué", "explica más", "cómo funciona eso", "continúa", "continua",
    "profundiza", "elabora", "qué más", "y el", "y la", "dame ejemplos", "muestra ejemplos", "cuáles son los riesgos", "cuáles son los requisitos",
)
# Verbs of short requests without an object.
VERBS = (
    "clarify compare continue describe detail elaborate explain expand give help include list need provide show tell use want aclara compara continua "
    "continúa detalla elabora explica amplia amplía dame ayuda incluye lista necesito proporciona muestra dime usa quiero"
).split()
# Openings of fragments, and words that make a fragment a question.
OPENINGS = "from for about with within under regarding concerning de del para por sobre con desde segun respecto acerca".split()
PREDICATES = (
    "how what when where which who whom whose why am are be can could did do does had has have is may must should was were will would como cuando cual "
    "cuales donde que quien quienes es son esta estan estuvo fue fueron hace hacen hay podria puede pueden sera seran tiene tienen"
).split()
# Words that are no topic.
FUNCTION_WORDS = (
    "a an and are be do does explain for how is know me of please tell the to what you implemented implementation funciona funcion como que sabes el la los "
    "las un una unos unas de del al para por con sobre es son esta estan cual cuales cuando donde quien y o en lo se su sus dame dime muestra "
    "muestrame necesito quiero explica describe resume"
).split()
# A turn that points back, and two shapes of a request that names its own subject.
REFERENTIAL = (
    r"\b(?:it|its|that|this|these|those|their|them|same|above|previous|here|earlier|previously|eso|esto|esa|ese|esos|esas|mismo|misma|anterior|aqui|aquí|arriba)\b"
)
INTERROGATIVE = (
    r"^(?:how|what|when|where|which|who|why|como|cómo|que|qué|cuando|cuándo|donde|dónde|cual|cuál|quien|quién)\b.{0,80}\b"
    r"(?:am|are|can|could|did|do|does|is|should|was|were|would|es|son|esta|está|estan|están|puede|pueden|hace|hacen)\b"
)
IMPERATIVE = (
    r"^(?:describe|explain|summarize|summarise|define|document|outline|detail|give|show|tell|list|provide|share|walk|name|find|get|i\s+(?:need|want)|explica|"
    r"explicame|explícame|resume|detalla|documenta|dame|dime|muestra|muestrame|muéstrame|enumera|lista|comparte|indica|cuentame|cuéntame|"
    r"proporciona|necesito|quiero)\s+(?!(?:(?:me|us|nos)\s+)?(?:more|further|again|más|mas)\b)"
)
TOKEN = r"[A-Za-zÀ-ÿ0-9][A-Za-zÀ-ÿ0-9_.:/-]*"
ANCHOR = r"\b[A-Z][A-Z0-9]{1,}(?:[_-][A-Z0-9]+)*\b"
SUBJECT_WORDS, SHORT_TURN, FRAGMENT, ELLIPSIS, ANCHORS = 12, 8, 6, 2, 6


def subject(text: Column) -> Column:
    """Up to twelve words a turn is about; empty for a turn that names nothing of its own."""
    found = F.transform(F.regexp_extract_all(text, F.lit(TOKEN), 0), lambda w: F.regexp_replace(w, "[.,:;]+$", ""))
    named = F.filter(found, lambda w: ~F.lower(w).isin(*IGNORED))
    telling = F.exists(named, lambda w: w.rlike("[-_.:/0-9]"))
    shown = F.array_join(F.slice(named, 1, SUBJECT_WORDS), " ")
    bare = F.coalesce(text.rlike(r"(?i)^\s*(?:i\s+)?need\s+for\s+"), F.lit(True))
    return F.when(bare | ((F.size(named) < 2) & ~telling), "").otherwise(shown)


def _any(words: Column, listed) -> Column:
    return F.arrays_overlap(words, F.array(*map(F.lit, listed)))


def _rules(text: Column) -> list[tuple[str, bool, Column]]:
    """(reason, is a follow-up, condition): the first that holds decides."""
    normal = F.lower(F.trim(text))
    folded = fold_accents(normal)
    words = F.array_distinct(normalized_words(normal))
    size = F.size(F.filter(F.split(normal, r"\s+"), lambda w: w != ""))
    bare = F.regexp_replace(normal, r"^[ ?¿!¡.]+|[ ?¿!¡.]+$", "")
    rest = F.regexp_replace(bare, r"^(?:and|y|also|además|ademas)\s+", "")
    topic = F.array_except(words, F.array(*map(F.lit, [*PRONOUNS, *FUNCTION_WORDS])))
    beyond = F.array_except(topic, F.array(*map(F.lit, [*DEMONSTRATIVES, *ATTRIBUTES, *IGNORED])))
    starts = F.lit(False)
    for prefix in PREFIXES:
        starts = starts | normal.startswith(prefix) | folded.startswith(fold_accents(F.lit(prefix)))
    explicit = ~normal.rlike(REFERENTIAL) & (normal.rlike(INTERROGATIVE) | normal.rlike(IMPERATIVE))
    points_back = _any(words, PRONOUNS)
    some = F.size(topic) > 0
    return [
        ("FOLLOWUP_PREFIX", True, starts),
        ("ELLIPTICAL_CONJUNCTION", True, (rest != bare) & (rest != "") & (F.size(F.split(F.trim(rest), r"\s+")) <= ELLIPSIS)),
        ("ANAPHORIC_PRONOUN", True, _any(words, [w for w in PRONOUNS if w not in INTRODUCING])),
        ("SHORT_VERB_ELLIPSIS", True, size.between(1, SHORT_TURN - 1) & _any(words, VERBS) & (subject(text) == "")),
        ("LEADING_FRAGMENT_CONTINUATION", True, F.get(words, F.lit(0)).isin(*OPENINGS) & (size <= FRAGMENT) & ~_any(words, PREDICATES)),
        ("DEMONSTRATIVE_ATTRIBUTE_FOLLOWUP", True, _any(words, DEMONSTRATIVES) & (F.size(beyond) == 0)),
        ("EXPLICIT_SUBJECT", False, some & (explicit | ((F.size(topic) >= 2) & ~points_back))),
        ("EXPLICIT_SUBJECT", False, some),
        ("ANAPHORIC_PRONOUN", True, points_back),
    ]


def follow_up(text: Column) -> tuple[Column, Column]:
    """Whether a turn carries on an earlier one, and why."""
    reason, follows = F.lit("NO_FOLLOWUP_SIGNAL"), F.lit(False)
    for name, verdict, condition in reversed(_rules(F.coalesce(text, F.lit("")))):
        reason = F.when(condition, name).otherwise(reason)
        follows = F.when(condition, verdict).otherwise(follows)
    return follows, reason


def marked(turns: DataFrame) -> DataFrame:
    """Each turn with what it says about itself: asked and told (subjects of either side), follow_up, reason."""
    said = F.coalesce("text", F.lit(""))
    named = F.nullif(subject(said), F.lit(""))
    follows, reason = follow_up(said)
    user = F.col("role") == "user"
    return turns.select(
        "conv_id", "turn", "role", "text", F.when(user, named).alias("asked"), F.when(F.col("role") == "assistant", named).alias("told"),
        F.when(user, follows).alias("follow_up"), F.when(user, reason).alias("reason"))


def resolved_question(text: Column, follows: Column, asked: Column, told: Column) -> Column:
    """A follow-up with the subject it carries on: the latest asked one, else the latest told."""
    carried = F.coalesce(asked, told)
    return F.when(follows & carried.isNotNull(), F.concat(F.regexp_replace(text, r"\s+$", ""), F.lit(" (previous subject: "), carried, F.lit(")"))).otherwise(text)


def folded(turns: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, follow_up, reason, active_subject, resolved) of the user turns.

    The state is the latest subject asked and the latest told. Turns are folded in blocks of
    BLOCK turns, and the blocks' last subjects are carried on, so a long conversation is
    neither one row nor one task.
    """
    rows = marked(turns).withColumn("block", F.floor(F.col("turn") / BLOCK))
    inside = Window.partitionBy("conv_id", "block").orderBy("turn")
    so_far, before = inside.rowsBetween(Window.unboundedPreceding, 0), inside.rowsBetween(Window.unboundedPreceding, -1)
    latest = {name: F.max_by(name, F.when(F.col(name).isNotNull(), F.col("turn"))) for name in ("asked", "told")}
    blocks = rows.groupBy("conv_id", "block").agg(*(value.alias(name) for name, value in latest.items()))
    earlier = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)  # a row for every BLOCK turns
    carried = blocks.select("conv_id", "block", *(F.last(name, ignorenulls=True).over(earlier).alias(f"old_{name}") for name in latest))
    seen = rows.withColumns({
        "now": F.last("asked", ignorenulls=True).over(so_far),
        **{f"last_{name}": F.last(name, ignorenulls=True).over(before) for name in latest}})
    state = seen.join(carried, ["conv_id", "block"]).withColumns({f"last_{n}": F.coalesce(f"last_{n}", f"old_{n}") for n in latest})
    active = F.coalesce("now", "old_asked", "last_told", F.lit(""))
    return state.where("role = 'user'").select(
        "conv_id", "turn", "follow_up", "reason", active.alias("active_subject"),
        resolved_question(F.coalesce("text", F.lit("")), F.col("follow_up"), F.col("last_asked"), F.col("last_told")).alias("resolved"))


def anchors(turns: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, anchors): identifiers a question shares with the answer before it, then its section ids."""
    pattern = F.lit(ANCHOR)
    own = F.array_distinct(F.regexp_extract_all("text", pattern, 0))
    answers = turns.where("role = 'assistant' AND trim(text) <> ''").select("conv_id", (F.col("turn") + 1).alias("turn"), own.alias("given"))
    asked = turns.where("role = 'user'").select("conv_id", "turn", own.alias("asked"))
    sections: Callable[[Column], Column] = lambda x: x.rlike(r"^[A-Z][A-Z0-9]*-\d+$")
    both = F.array_distinct(F.concat(F.array_intersect("given", "asked"), F.filter("given", sections)))
    return asked.join(answers, ["conv_id", "turn"]).select("conv_id", "turn", F.slice(both, 1, ANCHORS).alias("anchors"))
