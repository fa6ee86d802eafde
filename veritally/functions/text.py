"""Text of answers as columns: cleaning, extraction, verdicts, faults, prompts. Regular expressions read Unicode, as (?U)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ASCII punctuation, words that say nothing about a question, and the patterns that answers are read by.
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
CONTENT_STOPWORDS = (
    "this that with from have which their there would could should about what when where your they them then than into only also been were will just more most such other some very does each same both over like make made much many must answer "
    "final option options correct question because therefore since while these those being given following based statement"
).split()
ARTICLES = r"\b(a|an|the)\b"
ANSWER_SPAN = r"(?:final\s+answer|answer)[ \t]*(?:(?:is)[ \t]*:?[ \t]*|:[ \t]*)([^\n\r]+)"
ANSWER_TAIL = r"(?:final\s+answer|answer)\s*(?:is|:)?\s*([^\n\r]+)"
ANSWER_YES_NO = r"(?:final\s+answer|answer)\s*(?:is|:)?\s*(yes|no|true|false)\b"
YES_NO = r"\b(yes|no|true|false)\b"
FINAL_LINE = r"^[^\S\r\n]*(final\s+answer|answer)\s*(is|:)[^\n\r]*$"
ANSWER_PHRASE = r"final\s+answer\s*(?:is|:)?\s*\(?[a-z0-9./-]{0,16}\)?\.?"
CODE_MARK = r"#include\s*<|\bint\s+main\s*\(|^\s*def\s+\w+\s*\(|\bpublic\s+static\b|System\.out\.print|console\.log\(|^\s*(?:import|using\s+namespace)\s+\w+"
REPEATED_WORD = r"\b([a-z]\w+)(\s+\1\b){9,}"
VERDICT = r"verdict\s*:\s*\**\s*(accept|reject)"
CRITIQUE = r"critique\s*:\s*(.+)"
CORRECT_IS = r"(?:correct|right|true|actual)\s+(?:final\s+)?(?:answer|option|choice|result)\s*(?:is|:)\s*\(?([^\n\r.,;)]{1,60})"
REFUSAL = r"\bI\s+(can(not|'t)|will not|won't|must not|am not able to)\s+(help|assist|comply|provide|do|create|generate|produce|write|give|fulfil|fulfill)"
SETTING = (
    r"\b(mislead(ing)?|deliberately (wrong|incorrect|mistaken)|intentionally (wrong|incorrect|mistaken)|plausible but wrong|on purpose|as (instructed|asked|requested)|I was (asked|told|instructed)"
    r"|the instruction(s)? (say|said|ask)|this (is|was) an experiment|robustness experiment|subtle (bug|mistake|error)|pretend(ing)? to|flawed on purpose|wrong answer (is|must)|incorrect on purpose)\b"
)
WHITE = r"(?U)\s+"


def squeeze(x: Column) -> Column:
    return F.trim(F.regexp_replace(x, WHITE, " "))


def strip(x: Column) -> Column:
    return F.regexp_replace(x, r"(?U)^\s+|\s+$", "")


def last(items: Column) -> Column:
    return F.try_element_at(items, F.lit(-1))


def qa_normalise(x: Column) -> Column:
    """Lower case without ASCII punctuation and articles, single spaces."""
    bare = F.translate(F.lower(F.coalesce(x, F.lit(""))), PUNCTUATION, "")
    return squeeze(F.regexp_replace(bare, "(?U)" + ARTICLES, " "))


def _undotted(x: Column) -> Column:
    return F.regexp_replace(strip(x), r"^\.+|\.+$", "")


def _lines(x: Column) -> Column:
    """Lines with something on them, stripped."""
    return F.filter(F.transform(F.split(x, r"\r\n|[\n\r\x0B\f\x1C-\x1E\x85\u2028\u2029]"), strip), lambda v: v != "")


def _readable(x: Column) -> Column:
    return F.regexp_like(x, F.lit(r"[\p{L}\p{Nd}\p{Nl}\p{No}]"))


def qa_answer(x: Column) -> Column:
    """The last 'answer is/:' tail with a letter or digit, else the last such line, else the text."""
    raw = strip(F.coalesce(x, F.lit("")))
    tails = F.regexp_extract_all(raw, F.lit("(?i)" + ANSWER_SPAN), F.lit(1))
    tails = F.filter(F.transform(tails, _undotted), _readable)
    lines = F.filter(F.transform(_lines(raw), _undotted), _readable)
    return F.coalesce(last(tails), last(lines), _undotted(raw))


def tail_answer(x: Column) -> Column:
    """The last explicit answer tail, else the last line (multiple choice)."""
    raw = strip(F.coalesce(x, F.lit("")))
    tails = F.regexp_extract_all(raw, F.lit("(?i)" + ANSWER_TAIL), F.lit(1))
    return F.coalesce(strip(last(tails)), last(_lines(raw)), raw)


def short_answer(x: Column) -> Column:
    return _undotted(tail_answer(x))


def short_normalise(x: Column) -> Column:
    return qa_normalise(F.regexp_replace(strip(F.coalesce(x, F.lit(""))), r"^[()\[\]{}]+|[()\[\]{}]+$", ""))


def yes_no(x: Column) -> Column:
    """yes or no of a label, '' if neither is named."""
    t = F.lower(strip(F.coalesce(x, F.lit(""))))
    word = F.regexp_extract(t, "(?U)" + YES_NO, 1)
    return F.when(t.isin("1", "true", "yes"), "yes").when(t.isin("0", "false", "no"), "no").when(word.isin("yes", "true"), "yes").when(word.isin("no", "false"), "no").otherwise("")


def yes_no_answer(x: Column) -> Column:
    """The last explicit yes/no answer, else the last yes/no word."""
    raw = strip(F.coalesce(x, F.lit("")))
    explicit = F.regexp_extract_all(raw, F.lit("(?iU)" + ANSWER_YES_NO), F.lit(1))
    words = F.regexp_extract_all(raw, F.lit("(?iU)" + YES_NO), F.lit(1))
    return yes_no(F.coalesce(last(explicit), last(words), F.lit("")))


def option_label(x: Column) -> Column:
    bare = F.regexp_replace(strip(F.coalesce(x, F.lit(""))), r"^[()\[\]{}]+|[()\[\]{}]+$", "")
    return F.lower(strip(bare))


def choice_labels(labels: Column, choices: Column) -> Column:
    """Given labels, else A, B, C..."""
    letters = F.transform(F.coalesce(choices, F.array()), lambda c, i: F.char(F.lit(65) + i))
    return F.when(F.size(F.coalesce(labels, F.array())) > 0, labels).otherwise(letters)


def shared_words(p: Column, g: Column) -> Column:
    """How many words two lists share, counted with multiplicity: one walk over both, sorted together."""
    tagged = F.array_sort(F.concat(F.transform(p, lambda w: F.struct(w.alias("w"), F.lit(1).alias("a"), F.lit(0).alias("b"))), F.transform(g, lambda w: F.struct(w.alias("w"), F.lit(0).alias("a"), F.lit(1).alias("b")))))
    start = F.struct(F.lit("").alias("w"), F.lit(0).alias("a"), F.lit(0).alias("b"), F.lit(0).alias("shared"))

    def step(s, x):
        same = s["w"] == x["w"]
        kept = lambda n: F.when(same, s[n]).otherwise(0)
        return F.struct(x["w"].alias("w"), (kept("a") + x["a"]).alias("a"), (kept("b") + x["b"]).alias("b"), (s["shared"] + F.when(same, 0).otherwise(F.least(s["a"], s["b"]))).alias("shared"))

    return F.aggregate(tagged, start, step, lambda s: s["shared"] + F.least(s["a"], s["b"]))


def token_f1(prediction: Column, gold: Column) -> Column:
    """F1 of the words of two normalised texts, counted with multiplicity; 1 if both are empty."""
    words = lambda x: F.filter(F.split(qa_normalise(x), " "), lambda w: w != "")
    p, g = words(prediction), words(gold)
    common = shared_words(p, g)
    n, m = F.size(p), F.size(g)
    precision, recall = common.cast("double") / n.cast("double"), common.cast("double") / m.cast("double")
    return F.when((n == 0) & (m == 0), 1.0).when((n == 0) | (m == 0) | (common == 0), 0.0).otherwise(F.lit(2.0) * precision * recall / (precision + recall))


def best_f1(prediction: Column, golds: Column) -> Column:
    return F.coalesce(F.array_max(F.transform(golds, lambda g: token_f1(prediction, g))), F.lit(0.0))


def exact_match(prediction: Column, golds: Column) -> Column:
    return F.exists(golds, lambda g: qa_normalise(g) == qa_normalise(prediction))


def gold_answers(answer: Column, aliases: Column) -> Column:
    return F.filter(F.concat(F.array(F.coalesce(answer, F.lit(""))), F.coalesce(aliases, F.array().cast("array<string>"))), lambda g: F.trim(g) != "")


def without_thinking(x: Column) -> Column:
    return strip(F.substring_index(F.coalesce(x, F.lit("")), "</think>", -1))


def peer_block(x: Column, limit: int = 3000) -> Column:
    """What a reader sees of a response: after the thinking, or cut if it never ended or is too long."""
    t = F.coalesce(x, F.lit(""))
    cut = F.concat(F.regexp_replace(F.substring(t, 1, limit), r"(?U)\s+$", ""), F.lit("\n[... reasoning cut off, no final answer]"))
    return F.when(F.contains(t, F.lit("</think>")), without_thinking(t)).when(F.contains(t, F.lit("<think>")) | (F.length(t) > limit), cut).otherwise(t)


def clip(x: Column, limit: int) -> Column:
    t = strip(F.coalesce(x, F.lit("")))
    return F.when(F.length(t) <= limit, t).otherwise(F.concat(F.regexp_replace(F.substring(t, 1, limit), r"(?U)\s+$", ""), F.lit(" ...")))


def verdict(x: Column) -> Column:
    """ACCEPT or REJECT, the last one named; ACCEPT if none is."""
    named = F.regexp_extract_all(F.coalesce(x, F.lit("")), F.lit("(?i)" + VERDICT), F.lit(1))
    return F.upper(F.coalesce(last(named), F.lit("accept")))


def critique(x: Column, limit: int = 500) -> Column:
    t = F.coalesce(x, F.lit(""))
    tail = F.try_element_at(F.regexp_extract_all(t, F.lit("(?i)" + CRITIQUE), F.lit(1)), F.lit(1))
    return F.substring(strip(F.substring_index(F.coalesce(tail, t), "\n", 1)), 1, limit)


def word_list(x: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(x, F.lit(""))), F.lit(r"(?U)\w+"), F.lit(0))


def much_of_one_word(x: Column) -> Column:
    """Whether one word of over two characters is over 30 % (and over 20) of at least 30 words."""
    words = word_list(x)
    longer = F.array_sort(F.filter(words, lambda w: F.length(w) > 2))
    start = F.struct(F.lit("").alias("w"), F.lit(0).alias("n"), F.lit(0).alias("top"))

    def step(s, w):
        n = F.when(s["w"] == w, s["n"] + 1).otherwise(1)
        return F.struct(w.alias("w"), n.alias("n"), F.greatest(s["top"], n).alias("top"))

    run = F.aggregate(longer, start, step, lambda s: s["top"])
    return (F.size(words) >= 30) & (run > 20) & (run > F.lit(0.3) * F.size(words))


def looped(x: Column) -> Column:
    """One word ten times running, or much of one word."""
    t = F.lower(F.coalesce(x, F.lit("")))
    return F.regexp_like(t, F.lit("(?U)" + REPEATED_WORD)) | much_of_one_word(x)


def content_words(x: Column) -> Column:
    found = F.regexp_extract_all(F.lower(F.coalesce(x, F.lit(""))), F.lit(r"[a-z]{4,}"), F.lit(0))
    return F.array_distinct(F.filter(found, lambda w: ~w.isin(CONTENT_STOPWORDS)))


def off_topic(x: Column, source: Column) -> Column:
    """Program code, symbols, or prose that shares no content word with the question; a bare label is on topic."""
    body = strip(F.regexp_replace(F.coalesce(x, F.lit("")), "(?i)" + ANSWER_PHRASE, " "))
    code = F.regexp_like(body, F.lit("(?m)" + CODE_MARK))
    letters = F.length(F.regexp_replace(body, r"[^\p{L}]", ""))
    mine, theirs = content_words(body), content_words(source)
    strange = (F.size(mine) >= 8) & (F.size(theirs) >= 3) & ~F.arrays_overlap(mine, theirs)
    return (F.length(body) >= 20) & (code | ((F.length(body) > 60) & (letters < F.lit(0.25) * F.length(body))) | strange)


def leaks_gold(x: Column, golds: Column) -> Column:
    """Whether the text names a gold answer as the correct one."""
    claims = F.regexp_extract_all(F.coalesce(x, F.lit("")), F.lit("(?i)" + CORRECT_IS), F.lit(1))
    claims = F.filter(F.transform(claims, qa_normalise), lambda c: c != "")
    return F.exists(claims, lambda c: F.exists(F.transform(golds, qa_normalise), lambda g: (c == g) | ((F.length(g) > 2) & F.contains(c, g))))


def refuses(x: Column) -> Column:
    return F.regexp_like(F.coalesce(x, F.lit("")), F.lit("(?i)" + REFUSAL))


def leaks_setting(x: Column) -> Column:
    """Whether the text gives away that it was asked to mislead."""
    return F.regexp_like(F.coalesce(x, F.lit("")), F.lit("(?i)" + SETTING))


def argument_chars(x: Column) -> Column:
    """Characters besides final-answer lines."""
    return F.length(strip(F.regexp_replace(F.coalesce(x, F.lit("")), "(?im)" + FINAL_LINE, "")))


def context_text(passages: Column, limit: int = 8000) -> Column:
    numbered = F.transform(F.coalesce(passages, F.array().cast("array<string>")), lambda p, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "), p))
    return F.substring(F.array_join(numbered, "\n"), 1, limit)


def wrong_number(gold: Column, body: Column) -> Column:
    """The last number of the body that could be believed and is not the gold, else the gold moved by a tenth."""
    g = F.regexp_replace(strip(gold), ",", "").try_cast("double")
    found = F.regexp_extract_all(F.regexp_replace(F.coalesce(body, F.lit("")), ",", ""), F.lit(r"-?\d+(?:\.\d+)?"), F.lit(0))
    value = lambda t: t.try_cast("double")
    good = F.filter(found, lambda t: (g.isNull() | (F.abs(value(t) - g) >= 1e-9)) & (F.abs(value(t)) >= 2) & (F.abs(value(t)) <= 1e9))
    moved = g + F.greatest(F.lit(1.0), F.bround(F.abs(g) * 0.1))
    return F.coalesce(last(good), F.when(g.isNotNull(), F.when(moved == F.floor(moved), F.floor(moved).cast("string")).otherwise(moved.cast("string"))), F.lit("0"))


def filled_question(text: Column, answers: Column) -> Column:
    """`#k` becomes the k-th earlier answer; 'X >> relation' becomes a question."""
    t = F.aggregate(F.transform(answers, lambda a, i: F.struct(a.alias("a"), (i + 1).alias("k"))), text, lambda s, x: F.regexp_replace(s, F.concat(F.lit("#"), x["k"].cast("string"), F.lit(r"(?!\d)")), F.regexp_replace(x["a"], F.lit(r"([\\$])"), F.lit(r"\\$1"))))
    t = strip(t)
    parts = F.split(t, ">>", 2)
    asked = F.concat(F.lit("What is the '"), strip(F.get(parts, 1)), F.lit("' of "), strip(F.get(parts, 0)), F.lit("?"))
    return F.when(F.contains(t, F.lit(">>")), asked).otherwise(t)


def message(role: str, content: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), content.alias("content"))


def prompt(system: str, question: Column, blocks: Column, instruction: str, context: Column | None = None, limit: int = 3000) -> Column:
    """System and user messages: question, context if any, numbered source blocks, instruction."""
    peers = F.transform(blocks, lambda b, i: F.concat(F.lit("Peer "), (i + 1).cast("string"), F.lit(":\n"), clip(b, limit)))
    parts = [F.concat(F.lit("Question:\n"), question)]
    if context is not None:
        parts.append(F.when(context != "", F.concat(F.lit("Context:\n"), context)))
    parts += [F.when(F.size(peers) > 0, F.array_join(peers, "\n\n")), F.lit(instruction)]
    return F.array(message("system", F.lit(system)), message("user", F.concat_ws("\n\n", *parts)))


def debate(first: Column, history: Column, update: str) -> Column:
    """The first messages, then each earlier answer and the request to reconsider."""
    turns = F.flatten(F.transform(history, lambda a: F.array(message("assistant", a), message("user", F.lit(update)))))
    return F.concat(first, turns)
