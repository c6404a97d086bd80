"""Word lists and text columns shared by the text operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from palimpsest.functions.patterns import WS
from palimpsest.functions.splice import matches

# --- fixed values: character classes and splitters ---------------------------
CJK = r"\u4e00-\u9fff\u3400-\u4dbf"
CJK_RUN = f"[{CJK}]+"
LATIN_WORD = r"[A-Za-z0-9][A-Za-z0-9'+\-./]*"
SENTENCE_END = r"(?<=[。！？!?；;…\n\r])"
PARAGRAPH_GAP = rf"\n[{WS}]*\n|\r\n[{WS}]*\r\n"
TERMINAL = ("。", "！", "？", "!", "?", "；", ";")

# --- fixed values: stop words for keywords -----------------------------------
ZH_STOP = tuple("""
的 了 和 是 在 我 有 也 就 不 人 都 一 一个 上 你 他 她 它 这 那 这个 那个 这些 那些 我们 你们 他们 自己 之 与 及 或 而 但 却
因为 所以 但是 由于 对于 关于 通过 以及 能够 进行 方面 问题 情况 目前 已经 可能 应该 需要 认为 表示 一种 一些 这样 那样 如果
虽然 为了 从而 并且 或者 然后 此外 例如 比如 按照 根据 加以 予以 使得 成为 作为 位于 可以 不可 没有 不是 只是 这里 那里 怎么
什么 为什么 如何 多少 一项 一名 一位 其 其其 其中 其他 其余 本身 各自 同样 相反 如此 这么 那么 几 许多 一切 任何
""".split())
EN_STOP = tuple("""
the a an and or but if then else when while for to of in on at by with from as is are was were be been being it its this that
these those we you they he she i my your our their his her them can could should would may might must do does did have has had
will shall not no yes so because however therefore thus also more most other another such than into about over under again
further what which who whom whose how why where there here all any each every both either neither one two three first second
last new old get got use used using see seen make made like just only very can't don't won't isn't aren't doesn't didn't
""".split())

# --- fixed values: stop words for comparing two summaries --------------------
ZH_STOP_COMPARE = tuple("""
的 了 和 是 在 我 有 也 就 不 人 都 一 上 你 他 她 它 这 那 我们 你们 他们 之 与 及 或 而 但 因为 所以 但是 由于 对于 关于 通过
以及 能够 进行 方面 目前 已经 可能 应该 需要 认为 表示 一种 一些 这样 那样 如果 虽然 为了 从而 并且 然后 此外 例如 比如 按照
根据 使得 成为 作为 可以 没有 不是
""".split())
ZH_BOUNDARY = tuple("""
的 了 是 在 与 及 或 而 但 因 所 对 通 能 进 目 已 可 需 认 表 如 按 根 使 成 作 没 这 那 就 也 都 又 还 很 更 最 以 把 被 给 让
从 向 往 当 若 则 且
""".split())
EN_STOP_COMPARE = tuple("""
the a an and or but if then else when while for to of in on at by with from as is are was were be been being it its this that
these those we you they he she i my your our their his her them can could should would may might must do does did have has had
will shall not no yes so because however therefore thus also more most other another such than into about over under again what
which who whom whose how why where there here all any each every
""".split())

# --- fixed values: words that mark a concluding sentence ---------------------
SIGNALS = ("总之", "因此", "结论", "综上", "本文", "研究", "发现", "建议", "in conclusion", "therefore", "however",
           "we propose", "our findings", "this paper", "the result", "importantly")


#: The characters of the class ``WS``.
BLANKS = "".join(map(chr, (*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B),
                           0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))


def strip(text: Column) -> Column:
    """Without blanks at both ends; only the ends are looked at."""
    return F.btrim(text, F.lit(BLANKS))


def squeeze(text: Column) -> Column:
    """Trim and turn every run of whitespace into one space."""
    return F.trim(F.regexp_replace(text, f"[{WS}]+", " "))


def sentence_array(text: Column) -> Column:
    """Non-empty sentences.  An ASCII full stop does not end a sentence."""
    return F.filter(F.transform(F.split(text, SENTENCE_END), squeeze), lambda s: s != "")


def sentence_count(text: Column) -> Column:
    """How many sentences :func:`sentence_array` and :func:`located_sentences` give, without tidying them up."""
    return F.size(F.filter(F.split(text, SENTENCE_END), lambda s: F.rlike(s, F.lit(f"[^{WS}]"))))


def paragraph_array(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, PARAGRAPH_GAP), strip), lambda p: p != "")


def located_sentences(text: Column) -> Column:
    """``array<struct<para, sent, text>>``; paragraph from 0, sentence in it from 1."""
    return F.flatten(F.transform(
        paragraph_array(text),
        lambda p, i: F.transform(
            sentence_array(p),
            lambda s, j: F.struct(i.alias("para"), (j + 1).alias("sent"), s.alias("text")),
        ),
    ))


def language(text: Column) -> Column:
    """zh where runs of Chinese characters are at least as many as Latin words."""
    return F.when(
        F.regexp_count(text, F.lit(CJK_RUN)) >= F.regexp_count(text, F.lit(LATIN_WORD)), "zh"
    ).otherwise("en")


def latin_words(text: Column) -> Column:
    return F.transform(matches(text, LATIN_WORD), F.lower)


def grams(run: Column, n: int | Column) -> Column:
    """All n-grams of one string, in order."""
    size = F.lit(n) if isinstance(n, int) else n
    return F.when(
        F.length(run) >= size,
        F.transform(F.sequence(F.lit(1), F.length(run) - size + 1), lambda i: F.substr(run, i, size)),
    ).otherwise(F.array().cast("array<string>"))


def cjk_grams(text: Column, n: int) -> Column:
    """N-grams inside each run of Chinese characters, in order."""
    return F.when(
        text.rlike(f"[{CJK}]"), F.flatten(F.transform(matches(text, CJK_RUN), lambda r: grams(r, n)))
    ).otherwise(F.array().cast("array<string>"))


def similarity_tokens(text: Column) -> Column:
    """Distinct Chinese bigrams and lower-case Latin words of one sentence."""
    return F.array_distinct(F.concat(cjk_grams(text, 2), latin_words(text)))


def question_tokens(text: Column) -> Column:
    """Like :func:`similarity_tokens`, with lone characters kept and one-letter words dropped."""
    lone = F.when(
        text.rlike(f"[{CJK}]"), F.filter(matches(text, CJK_RUN), lambda r: F.length(r) == 1)
    ).otherwise(F.array().cast("array<string>"))
    words = F.filter(latin_words(F.lower(text)), lambda w: F.length(w) > 1)
    return F.array_distinct(F.concat(cjk_grams(text, 2), lone, words))


def jaccard(a: Column, b: Column) -> Column:
    shared = F.size(F.array_intersect(a, b))
    union = F.size(a) + F.size(b) - shared
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(shared / union)
