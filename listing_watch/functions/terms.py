"""Candidate terms of titles and descriptions, by runs of one script.

A run is a stretch of katakana, hiragana, kanji, or ASCII letters and digits with hyphens. Terms
are the runs, two adjoining runs, and phrases that cross short hiragana. The walk over offsets is
a small Python helper over some texts at a time; everything about the terms after that is native."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterable, Iterator
from itertools import pairwise

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .scalars import term_weight_hint
from .text import HIRAGANA, KATAKANA, KEPT, few_at_once, tight

#: Words of listings that say nothing about the item.
STOP_WORDS = """
商品 発送 状態 購入 即購入 ご購入 御購入 梱包 包装 返品 返金 交換 キャンセル 不可
神経質 完璧 完品 中古 中古品 送料 込み 無料 値下 値下げ 交渉 専用 コメント 質問
画像 写真 参考 判断 保管 保存 環境 喫煙 喫煙者 ペット 素人 自宅 当方 当時
使用 未使用 未開封 開封 開封済 新品 美品 良品 難あり 傷 汚れ スレ 折れ 剥がれ 白カケ
方法 発送方法 ネコポス ゆうパケット ゆうパケットポスト メルカリ メルカリ便 ゆうゆう
らくらく 匿名 匿名配送 配送 段ボール ダンボール 封筒 厚紙 スリーブ ローダー 補強
水濡れ 防止 すり替え 対応 以上 以下 場合 可能 出品 出品者 早い者勝ち バラ売り
到着 日時 時間 翌日 翌々日 以内 予定 連絡 総合 評価 全体 種別 詳細 内容 記載 説明
納得 理解 了承 遠慮 検討 幸い 注意 注意点 その他 こちら どうぞ お願い 宜しく
よろしく 致します 頂きます ください 下さい 思います 大丈夫 気軽 追加 限り 範囲
番号 枚 個 点 本 冊 組 束 円 円分 税込 期間 現在 実物 本物 全て 上記 下記
ありがとう ございます お手数 恐れ入り プロフィール 一読 必読 サイズ 重量
綺麗 きれい 時間 時間以内 以内 プレイ用 収納 暗所 保存環境 講習会 定員 開催 参加
主観 過度 割 反り 初期 判断 総合評価 交渉中 現状 現状渡し 動作 動作確認 未確認
折り 曲げ 日焼け 経年 経年劣化 汚 小傷 擦れ 個人 個人保管 完璧主義
""".split()
#: Words too broad to name an item.
GENERIC_WORDS = """
カード シングルカード セット まとめ まとめ売り 大量 コレクション レア 限定 希少
当時物 レトロ ビンテージ ヴィンテージ 昭和 平成 ジャンク 訳あり 訳有り
ゲーム グッズ アイテム 本体 付属 付属品 おまけ 特典
カードゲーム トレカ トレーディングカード プロモ プロモカード 特典カード
""".split()
#: Single hiragana that end a fragment, and counters.
PARTICLES = "をのにはがともでへやかねよなばらしぬ"
COUNTERS = "枚|個|点|本|冊|組|束|台|巻|セット"
#: Hyphens inside codes, the middle dot, and limits of bridged phrases.
HYPHENS = "-‐‑–—_"
MIDDLE_DOT = "・"
BRIDGE, CONTENT_RUNS, PHRASE_CHARS, PHRASES = 3, 5, 16, 240
MAX_TIGHT = 24

_FOLD = str.maketrans(KATAKANA, HIRAGANA)
_DROP = re.compile(f"[^{KEPT}]+")
_RUNS = re.compile(
    f"(?P<K>[ァ-ヾ]+)|(?P<H>[ぁ-ゖ]+)|(?P<J>[一-鿿々〇〻]+)|(?P<A>[0-9A-Za-z{re.escape(HYPHENS)}]+)"
)
_EDGES = {"A": HYPHENS, "K": MIDDLE_DOT}
_ASCII_RUN = re.compile(f"[0-9A-Za-z{re.escape(HYPHENS)}]+")
_OTHER_RUN = re.compile("[ァ-ヾぁ-ゖ一-鿿々〇〻]")


RUN = T.ArrayType(T.StructType([T.StructField("surface", T.StringType()), T.StructField("script", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))
TERM = T.ArrayType(T.StructType([T.StructField("term", T.StringType()), T.StructField("term_t", T.StringType())]))


def tight_word(text: str) -> str:
    if text.isascii():  # only case and what is dropped are left to look at
        return text.lower() if text.isalnum() else _DROP.sub("", text.lower())
    return _DROP.sub("", unicodedata.normalize("NFKC", text).lower().translate(_FOLD))


STOP_TIGHT = sorted({t for t in map(tight_word, STOP_WORDS) if t})
GENERIC_TIGHT = sorted({t for t in map(tight_word, GENERIC_WORDS) if t})
_STOPS = frozenset(STOP_TIGHT)


def runs_of(text: str) -> list[tuple[str, str, int, int]]:
    """(surface, script, start, end) of the runs of an NFKC text, edges stripped."""
    out = []
    for m in _RUNS.finditer(text):
        word, edge, a = m[0], _EDGES.get(m.lastgroup, ""), m.start()
        if word[0] in edge or word[-1] in edge:
            a += len(word) - len(word.lstrip(edge))
            word = word.strip(edge)
        if word:
            out.append((word, m.lastgroup, a, a + len(word)))
    return out


def _phrases(text: str, runs: list[tuple[str, str, int, int]]) -> Iterator[str]:
    for i, (_, kind, start, end) in enumerate(runs):
        if kind == "H":
            continue
        content, crossed = 1, False
        for word, k, a, b in runs[i + 1 :]:
            if content > CONTENT_RUNS or a != end or (k == "H" and len(word) > BRIDGE) or b - start > PHRASE_CHARS:
                break
            crossed |= k == "H"
            content += k != "H"
            if crossed and not (k == "H" and word in PARTICLES and len(word) == 1):
                yield text[start:b]
            end = b


def tight_terms(text: str | None, max_len: int = MAX_TIGHT) -> dict[str, str]:
    """The surface of each tight form of the terms of a text, in order of extraction."""
    plain = unicodedata.normalize("NFKC", text or "")
    if not _OTHER_RUN.search(plain):
        # runs of one script never adjoin, so that the terms are the runs, of which each word counts once
        return _tights((w.strip(HYPHENS) for w in dict.fromkeys(_ASCII_RUN.findall(plain))), max_len)
    runs = runs_of(plain)
    found = [w for w, k, _, _ in runs if k != "H" and not (k == "J" and len(w) < 2)]
    found += [x[0] + y[0] for x, y in pairwise(runs) if x[3] == y[2] and "H" not in (x[1], y[1])]
    for n, phrase in enumerate(_phrases(plain, runs)):
        if n == PHRASES:
            break
        found.append(phrase)
    return _tights(found, max_len)


def _tights(found: Iterable[str], max_len: int) -> dict[str, str]:
    out: dict[str, str] = {}
    for word in dict.fromkeys(found):
        t = tight_word(word)
        if 2 <= len(t) <= max_len and not t.isdigit() and t not in _STOPS:
            out.setdefault(t, word)
    return out


def terms_of(text: str | None, max_len: int = MAX_TIGHT) -> list[str]:
    """Surfaces of the terms of a text, in order of extraction, one for each tight form."""
    return list(tight_terms(text, max_len).values())


def _lists(batches: Iterator[pa.Array], of: Callable[[str], list[tuple]], kind: T.ArrayType) -> Iterator[pa.Array]:
    """The rows that `of` makes of each text, as arrays of structs."""
    types = {"string": pa.string(), "int": pa.int32()}
    fields = [pa.field(f.name, types[f.dataType.simpleString()]) for f in kind.elementType]
    for b in batches:
        for texts in few_at_once(b):
            rows, ends = [], [0]
            for x in texts.to_pylist():
                rows += of(x or "")
                ends.append(len(rows))
            flat = [pa.array(c, f.type) for f, c in zip(fields, zip(*rows) if rows else [()] * len(fields))]
            yield pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(flat, fields=fields))


@F.arrow_udf(RUN)
def _script_runs(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    yield from _lists(batches, lambda x: runs_of(unicodedata.normalize("NFKC", x)), RUN)


@F.arrow_udf(TERM)
def _extract_terms(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    yield from _lists(batches, lambda x: [(w, t) for t, w in tight_terms(x).items()], TERM)


def script_runs(text: Column) -> Column:
    """Array of (surface, script K/H/J/A, start, end) over the NFKC text."""
    return _script_runs(text)


def extract_terms(text: Column) -> Column:
    """Array of (term, term_t) in order of extraction."""
    return _extract_terms(text)


def is_stopword(term_t: Column) -> Column:
    return term_t.isin(STOP_TIGHT)


def is_generic(term_t: Column) -> Column:
    return term_t.isin(GENERIC_TIGHT)


def is_counter(term_nfkc: Column) -> Column:
    """A bare quantity: digits and a counter."""
    return term_nfkc.rlike(rf"^\d+({COUNTERS})$")


def card_terms(title: Column, description: Column, limit: int = 40) -> Column:
    """Struct of terms, tterms (aligned), generic and tt of one listing: the most telling terms
    first, then the longer, then in order of extraction."""
    text = F.trim(F.concat_ws(" ", F.nullif(title, F.lit("")), F.nullif(description, F.lit(""))))
    found = F.transform(
        extract_terms(text),
        lambda x, i: F.struct((-term_weight_hint(x["term_t"], is_generic(x["term_t"]))).alias("h"), (-F.length(x["term_t"])).alias("n"), i.alias("i"), x["term"].alias("term"), x["term_t"].alias("term_t"), is_generic(x["term_t"]).alias("g")),
    )
    best = F.struct(F.slice(F.sort_array(found), 1, limit).alias("best"), tight(text).alias("tt"))
    made = lambda x: F.struct(
        F.transform(x["best"], lambda y: y["term"]).alias("terms"),
        F.transform(x["best"], lambda y: y["term_t"]).alias("tterms"),
        F.transform(F.filter(x["best"], lambda y: y["g"]), lambda y: y["term_t"]).alias("generic"),
        x["tt"].alias("tt"),
    )
    # a lambda's variable is worked out once, where a column would be at each use
    return F.get(F.transform(F.array(best), made), F.lit(0))
