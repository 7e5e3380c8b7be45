"""Languages of documents and of their mixed-language segments.

A linear-chain conditional random field labels words with languages: emissions from affixes, character n-grams, a small
lexicon of function words and scripts, transitions learned, marginals by forward-backward.
"""

from __future__ import annotations

import hashlib
import io
import re
import unicodedata
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeloom.plans.cut import read_bytes, write_bytes
from codeloom.plans.spread import spread

LANGUAGES = ("de", "en", "es", "fr", "it", "ja", "nl", "pt", "ru", "zh")
#: Labelled documents that the field is fitted on at most (a documented bound, whatever the corpus), and of them those that any language gets.
SAMPLE = 6000
PER_LANGUAGE = 300
SAMPLE_CHARS = 3000
#: Words of a sentence and of a chain, and sentences, that the fit takes at most; labels are given to whole texts.
SENTENCE_WORDS, CHAIN_WORDS, SENTENCES = 80, 400, 25_000
#: Notations of labels that are counted for the shares of the sample, the most frequent first.
NOTATIONS = 2000
BUCKETS = 1 << 16
#: A sentence's language needs this mean marginal to count as found.
MIN_CONFIDENCE = 0.5

# Usual notations of languages, ISO 639 codes and names. Others are taken for another language if they look like a code or name.
NAMES = {
    "de": "de deu ger german deutsch allemand alemán aleman tedesco", "en": "en eng english englisch anglais inglés ingles inglese", "es": "es spa spanish español espanol castellano castilian spanisch espagnol",
    "fr": "fr fra fre french français francais französisch franzosisch francés", "it": "it ita italian italiano italienisch italien", "ja": "ja jpn jp japanese 日本語 japanisch japonais", "nl": "nl nld dut dutch nederlands flemish vlaams niederländisch néerlandais",
    "pt": "pt por portuguese português portugues portugiesisch portugais brazilian", "ru": "ru rus russian русский russisch russe", "zh": "zh zho chi cmn chinese 中文 汉语 漢語 mandarin chinesisch chinois cn",
}
NO_LANGUAGE = frozenset("und unk unknown none null nil na n/a mis mul zxx xx ?? ? - -- . other undefined undetermined missing tbd".split())
_CODE = {name: code for code, names in NAMES.items() for name in names.split()}

# Frequent function words.
LEXICON = {
    "de": "der die das und ist nicht ein eine einen dem den des im von zu mit für auf wird wurde werden hat sich auch nach bei aus ohne wenn weil dass obwohl bevor ich wir bitte jeder unser ihre keine als sobald darf",
    "en": "the a an and is are was were not of to in for on with that this it its by be has have from at as or we you they should may each every no when before after because although without our there please could more than",
    "es": "el la los las un una y es no de del en por para con que se su al lo hay cada cuando antes después sin aunque porque más solo este esta nuestro hemos está muy",
    "fr": "le la les un une des et est ne pas de du en pour avec que qui se son sa au aux nous je il elle ce cette chaque quand avant après sans bien parce plus trop notre sont merci",
    "it": "il lo la i gli le un una e è non di del della in per con che si su al alla ogni quando prima dopo senza anche perché più solo questo questa nostro abbiamo sono dei delle troppo",
    "ja": "は が を に で と の も から まで です ます した して ない ので この その",
    "nl": "de het een en is niet van in op voor met dat die te aan er bij door uit wordt werd worden zonder wanneer omdat hoewel voordat tijdens ik we elke onze deze geen zeer alsjeblieft naar",
    "pt": "o a os as um uma e é não de do da em no na por para com que se seu ao cada quando antes depois sem embora porque mais só este esta nosso vimos são dos das muito",
    "ru": "и в не на с что по из к для от до это как так но мы я он она они хотя потому без при после перед каждый наш пожалуйста",
    "zh": "的 了 是 在 不 和 有 我 们 这 个 请 之 前 而 没 从 被 把 对 因 为",
}
_IN = {}
for _lang, _list in LEXICON.items():
    for _w in _list.split():
        _IN.setdefault(_w, []).append(_lang)

_FENCE = re.compile(r"^[ \t]*(```|~~~)[^\n]*\n.*?(?:^[ \t]*\1[ \t]*$|\Z)", re.M | re.S)
_SPAN = re.compile(r"``[^`\n]*``|`[^`\n]*`")
_LINK = re.compile(r"https?://\S+|<[/!]?\w[^>\n]*>|&\w+;|\S+@\S+\.\w+")
_INVISIBLE = re.compile("[­​-‏‪-‮⁠-⁤﻿]")
_PREFIX = re.compile(r"^[ \t]*[A-Za-z][\w-]*(?:\([\w ./,-]*\))!?:[ \t]+|^[ \t]*(?:feat|fix|docs|chore|refactor|test|build|ci|perf|style|revert)!?:[ \t]+", re.M)
_MARK = re.compile(r"^[ \t]*(?:(?:>|[*+•-]|\d+[.)]|\[[ xX]\])[ \t]+|>)+")
_NOT_PROSE = re.compile(r"^[ \t]*(?:#|\||//|/\*|\*/|\"\"\"|'''|[-=*_~]{3,}[ \t]*$|\$ |@\w|<<<<<<<|>>>>>>>|[0-9a-f]{2}( [0-9a-f]{2})+)")
_CODE_LINE = re.compile(r"[;{}]\s*$|^\s*[})\]]|^\s*(?:def|class|func|fn|pub|let|const|var|return|import|from|async|await|use|package|raise|throw|elif|else|try|except|with|for|while|if|match|switch|case|default)\b.*[:({=;]\s*$|\w\s*(?::=|=>|->|\+=|==|!=|&&|\|\|)\s*\S|^\s*[\w.]+\s*=\s*\S|^\s*(?:raise\s+|throw\s+|defer\s+|await\s+)?[\w.]+\(.*\)(?:\s+from\s+\w+)?\s*$|=\s*$|^\s*(?:return|break|continue|pass|None|nil|null)\b\s*\w*\s*$")
_END = re.compile(r"(?<=[。！？])[」』）)\"'”»]*|(?<=[.!?…])[)\"'”»）]*(?=\s|$)")
_WORD = re.compile(r"[぀-ヿㇰ-ㇿ㐀-䶿一-鿿ｦ-ﾟ]|[^\W\d_]+(?:['’][^\W\d_]+)*")
_CJK = re.compile(r"[぀-ヿ㐀-䶿一-鿿ｦ-ﾟ]")
_FULL = re.compile(r"[.!?…。！？][)\"'”»）」』]*$")
_IDENTIFIER = re.compile(r"\b\w+(?:_\w+)+\b|\b[a-z]+[A-Z]\w*\b|\b[\w-]+(?:\.[\w-]+)*\(\)|(?<!\S)[\w.-]+/[\w./-]+|\b[A-Za-z]\w*::\w[\w:]*")


def sentences(text: str | None) -> list[tuple[str, list[str], bool]]:
    """(sentence, words, whether it is a full sentence) of the prose in a text.

    Fenced and plain code, code spans, identifiers, headings, tables, rules, commit prefixes and list marks are taken out. A full
    sentence has an end mark and at least three words, or five letters of a script without spaces.
    """
    if not text or text.isspace():
        return []
    text = text.replace("\r\n", "\n").replace("\r", "\n").replace(" ", "\n").replace("\x85", "\n")
    if "```" in text or "~~~" in text:
        text = _FENCE.sub("\n\n", text)
    if not text.isascii():
        text = _INVISIBLE.sub("", unicodedata.normalize("NFC", text))
    if "`" in text:
        text = _SPAN.sub(" ", text)
    if "<" in text or "@" in text or "&" in text or "://" in text:
        text = _LINK.sub(" ", text)
    out, block = [], []

    def close():
        if block:
            out.extend(x for x in _END.split(" ".join(block)) if x)
            block.clear()

    for line in text.split("\n"):
        head = line.lstrip(" \t")[:1]
        bare = line if head.isalpha() else _MARK.sub("", line)
        if bare != line:
            close()
        inner = _MARK.sub("", _PREFIX.sub("", bare)) if ":" in bare or bare != line else bare
        if not inner.strip() or _NOT_PROSE.match(inner) or _CODE_LINE.search(inner):
            close()
            continue
        block.append(inner.strip())
        if _FULL.search(inner.rstrip()):
            close()
    close()
    found = []
    for s in out:
        s = s.strip()
        if s.isascii():
            words = _WORD.findall(_IDENTIFIER.sub(" ", s).lower())
            cjk = 0
        else:
            words = [w.lower() for w in _WORD.findall(_IDENTIFIER.sub(" ", s))]
            cjk = sum(1 for w in words if len(w) == 1 and _CJK.match(w))
        if not words:
            continue
        full = bool(_FULL.search(s)) and (len(words) - cjk >= 3 or cjk >= 5)
        found.append((s, words, full))
    return found


class _Placed:
    """A text with the place that each of its characters has in the text it was made of."""

    def __init__(self, text: str, start: np.ndarray | None = None, end: np.ndarray | None = None):
        self.text = text
        self.start = np.arange(len(text)) if start is None else start
        self.end = self.start + 1 if end is None else end

    def __getitem__(self, span: slice) -> _Placed:
        return _Placed(self.text[span], self.start[span], self.end[span])

    def strip(self) -> _Placed:
        left = len(self.text) - len(self.text.lstrip())
        return self[left:max(left, len(self.text.rstrip()))]

    def behind(self, text: str) -> _Placed:
        """What is left of it once something was taken off its front."""
        return self[len(self.text) - len(text):]

    def sub(self, pattern: re.Pattern, new: str) -> _Placed:
        parts, last = [], 0
        for m in pattern.finditer(self.text):
            parts += [self[last:m.start()], _Placed(new, np.zeros(len(new), np.int64))]
            last = m.end()
        return self if not parts else _Placed.join([*parts, self[last:]])

    def composed(self) -> _Placed:
        """In normal form C, each letter at the place of all its marks."""
        if unicodedata.is_normalized("NFC", self.text):
            return self
        parts, at, n = [], 0, len(self.text)
        while at < n:
            stop = at + 1
            while stop < n and (unicodedata.combining(c := self.text[stop]) or "\u1160" <= c <= "\u11ff" or len(unicodedata.normalize("NFC", self.text[stop - 1:stop + 1])) == 1):
                stop += 1
            new = unicodedata.normalize("NFC", self.text[at:stop])
            parts.append(_Placed(new, np.full(len(new), self.start[at]), np.full(len(new), self.end[stop - 1])))
            at = stop
        return _Placed.join(parts)

    @staticmethod
    def join(parts: list[_Placed], between: str = "") -> _Placed:
        if between:
            space = _Placed(between, np.zeros(len(between), np.int64))
            parts = [x for p in parts for x in (space, p)][1:]
        return _Placed("".join(p.text for p in parts), np.concatenate([p.start for p in parts]), np.concatenate([p.end for p in parts]))


_BREAK = re.compile("\r\n|[\r\u2028\x85]")


def placed_words(text: str | None) -> list[list[tuple[str, int, int]]]:
    """The words of :func:`sentences` with their start and end in the text as it was given."""
    if not text or text.isspace():
        return []
    now = _Placed(text).sub(_BREAK, "\n")
    if "```" in now.text or "~~~" in now.text:
        now = now.sub(_FENCE, "\n\n")
    if not now.text.isascii():
        now = now.composed().sub(_INVISIBLE, "")
    now = now.sub(_SPAN, " ").sub(_LINK, " ")
    out, block = [], []

    def close():
        if block:
            whole = _Placed.join(block, " ")
            last = 0
            for m in [*_END.finditer(whole.text), None]:
                out.append(whole[last:m.start() if m else len(whole.text)])
                last = m.end() if m else last
            block.clear()

    at = 0
    for line in now.text.split("\n"):
        here = now[at:at + len(line)]
        at += len(line) + 1
        bare = _MARK.sub("", line)
        if bare != line:
            close()
        inner = _MARK.sub("", _PREFIX.sub("", bare))
        if not inner.strip() or _NOT_PROSE.match(inner) or _CODE_LINE.search(inner):
            close()
            continue
        block.append(here.behind(inner).strip())
        if _FULL.search(inner.rstrip()):
            close()
    close()
    found = []
    for s in out:
        s = s.strip().sub(_IDENTIFIER, " ")
        if words := [(m.group().lower(), int(s.start[m.start()]), int(s.end[m.end() - 1])) for m in _WORD.finditer(s.text)]:
            found.append(words)
    return found


def _script(w: str) -> str:
    c = w[0]
    if "぀" <= c <= "ゟ":
        return "hira"
    if "゠" <= c <= "ヿ" or "ｦ" <= c <= "ﾟ":
        return "kata"
    if "㐀" <= c <= "鿿":
        return "han"
    if "Ѐ" <= c <= "ԯ":
        return "cyrl"
    return "latn" if c < "ɐ" else "else"


def features(w: str) -> list[int]:
    """Hashed features of a lower-case word: itself, affixes, character n-grams, lexicon, script."""
    box = f"^{w}$"
    names = ["b", "s" + _script(w), "w" + w]
    names += [f"p{w[:k]}" for k in (1, 2, 3) if len(w) > k] + [f"e{w[-k:]}" for k in (1, 2, 3, 4) if len(w) > k]
    names += ["2" + box[i:i + 2] for i in range(len(box) - 1)] + ["3" + box[i:i + 3] for i in range(len(box) - 2)]
    names += ["l" + lang for lang in _IN.get(w, ())]
    return sorted({zlib.crc32(n.encode()) % BUCKETS for n in names})


class Field:
    """The conditional random field: emission weights by feature, transition and start weights."""

    def __init__(self):
        n = len(LANGUAGES)
        self.w = np.zeros((BUCKETS, n), np.float32)
        self.t = np.zeros((n, n))
        self._forget()

    def _forget(self) -> None:
        self.place: dict[str, int] = {}
        self.rows = np.zeros((1024, len(LANGUAGES)), np.float32)

    def __getstate__(self):
        return self.w, self.t

    def __setstate__(self, state):
        self.w, self.t = state
        self._forget()

    def emissions(self, words: list[str]) -> np.ndarray:
        """Scores of words; those of a word are kept, as they don't depend on its neighbours."""
        if len(self.place) > 150_000:
            self._forget()
        place = self.place
        for w in set(words):
            if w not in place:
                i = place[w] = len(place)
                if i >= len(self.rows):
                    self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
                self.rows[i] = self.w[features(w)].sum(0)
        return self.rows[np.fromiter(map(place.__getitem__, words), np.int64, len(words))]

    def marginals(self, e: np.ndarray, lengths: np.ndarray, count: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Forward-backward over a padded batch (sequences, time, languages): word marginals, expected transitions (with ``count``), log Z."""
        b, steps, n = e.shape
        grow = np.exp(self.t).astype(e.dtype)
        shift = e.max(2, keepdims=True)
        x = np.exp(e - shift)
        alpha, scale = np.empty_like(x), np.ones((b, steps), e.dtype)
        a = x[:, 0]
        for i in range(steps):
            if i:
                a = (alpha[:, i - 1] @ grow) * x[:, i]
            scale[:, i] = z = a.sum(1)
            alpha[:, i] = a / z[:, None]
        beta = np.ones((b, n), e.dtype)
        out = np.empty_like(x)
        moves = np.zeros((n, n))
        for i in range(steps - 1, -1, -1):
            last = (i >= lengths - 1)[:, None]
            beta[last[:, 0]] = 1
            p = alpha[:, i] * beta
            out[:, i] = p / p.sum(1, keepdims=True)
            if i:
                ahead = beta * x[:, i] / scale[:, i][:, None]
                if count:
                    live = (i < lengths)[:, None]
                    moves += grow * ((alpha[:, i - 1] * live).T @ ahead)
                beta = ahead @ grow.T
        inside = np.arange(steps)[None, :] < lengths[:, None]
        return out, moves, (np.where(inside, np.log(scale) + shift[:, :, 0], 0)).sum(1)

    def words(self, flat: list[list[str]]):
        """(index, marginals by word and language) of each list of words that isn't empty."""
        order = sorted((i for i, f in enumerate(flat) if f), key=lambda i: len(flat[i]))
        at = 0
        while at < len(order):
            longest = len(flat[order[min(len(order) - 1, at + 1023)]])
            size = max(1, min(1024, 200_000 // max(1, longest)))
            part = order[at:at + size]
            at += size
            lengths = np.array([len(flat[i]) for i in part])
            inside = np.arange(int(lengths.max()))[None, :] < lengths[:, None]
            e = np.zeros((*inside.shape, len(LANGUAGES)), np.float32)
            e[inside] = self.emissions([w for i in part for w in flat[i]])
            p, _, _ = self.marginals(e, lengths, False)
            for row, i in enumerate(part):
                yield i, p[row, :lengths[row]]

    def label(self, texts: list[list[list[str]]]) -> list[list[tuple[str, float]]]:
        """Per document, per sentence: language and confidence (the mean marginal of its words), the chain running through the document."""
        out: list[list[tuple[str, float]]] = [[] for _ in texts]
        for i, p in self.words([[w for s in t for w in s] for t in texts]):
            sizes = np.array([len(s) for s in texts[i]])
            filled = np.flatnonzero(sizes)
            means = np.add.reduceat(p, (np.cumsum(sizes) - sizes)[filled], axis=0) / sizes[filled][:, None]
            best = means.argmax(1)
            out[i] = [(LANGUAGES[k], float(m[k])) for k, m in zip(best.tolist(), means)]
        return out

    def runs(self, flat: list[list[str]]) -> list[list[tuple[int, int, str, float]]]:
        """Per document the maximal runs of words of one language: first word, the one behind the last, language, mean marginal."""
        out: list[list[tuple[int, int, str, float]]] = [[] for _ in flat]
        for i, p in self.words(flat):
            best = p.argmax(1)
            cuts = [0, *(np.flatnonzero(np.diff(best)) + 1).tolist(), len(best)]
            out[i] = [(a, b, LANGUAGES[best[a]], float(p[a:b, best[a]].mean())) for a, b in zip(cuts, cuts[1:])]
        return out

    def fit(self, labelled: list[tuple[list[str], int]], epochs: int = 4, seed: int = 7) -> Field:
        """Stochastic gradient steps (AdaGrad) on the likelihood of chains made of labelled sentences.

        Chains of up to four sentences switch language now and then, as mixed documents do, so that the transitions learn how rarely that happens.
        """
        rng = np.random.default_rng(seed)
        n = len(LANGUAGES)
        labels = [k for _, k in labelled]
        vocabulary = {w: i for i, w in enumerate(dict.fromkeys(w for words, _ in labelled for w in words))}
        feats = [np.array(features(w)) for w in vocabulary]
        many = np.array([len(f) for f in feats])
        numbered = [np.array([vocabulary[w] for w in words]) for words, _ in labelled]
        gw, gt = np.full((BUCKETS, n), 1e-2, np.float32), np.full((n, n), 1e-2)
        by = {k: [i for i, y in enumerate(labels) if y == k] for k in range(n)}
        for _ in range(epochs):
            chains, order, i = [], rng.permutation(len(labelled)), 0
            while i < len(order):
                chain = [order[i]]
                while rng.random() < 0.5 and len(chain) < 4:
                    own = by[labels[chain[-1]]]
                    chain.append(int(rng.integers(len(labelled))) if rng.random() < 0.2 else own[int(rng.integers(len(own)))])
                chains.append(chain)
                i += 1
            for at in range(0, len(chains), 64):
                words = [np.concatenate([numbered[i] for i in c])[:CHAIN_WORDS] for c in chains[at:at + 64]]
                gold = [np.concatenate([np.full(len(numbered[i]), labels[i]) for i in c])[:CHAIN_WORDS] for c in chains[at:at + 64]]
                lengths = np.array([len(x) for x in words])
                # a word's score and gradient are the same wherever it stands
                used, which = np.unique(np.concatenate(words), return_inverse=True)
                flat = np.concatenate([feats[i] for i in used])
                owner = np.repeat(np.arange(len(used)), many[used])
                scores = np.add.reduceat(self.w[flat].astype(np.float64), np.cumsum(many[used]) - many[used], axis=0)
                mask = np.arange(int(lengths.max()))[None, :] < lengths[:, None]
                e = np.zeros((*mask.shape, n))
                e[mask] = scores[which]
                p, moves, _ = self.marginals(e, lengths)
                y = np.concatenate(gold)
                delta = p[mask]
                delta[np.arange(len(y)), y] -= 1
                seen = np.zeros((n, n))
                for g in gold:
                    np.add.at(seen, (g[:-1], g[1:]), 1)
                mine = np.stack([np.bincount(which, weights=delta[:, j], minlength=len(used)) for j in range(n)], 1)
                touched, back = np.unique(flat, return_inverse=True)
                grad = np.stack([np.bincount(back, weights=mine[owner, j], minlength=len(touched)) for j in range(n)], 1) / len(words)
                gw[touched] += grad**2
                self.w[touched] -= (0.3 * grad / np.sqrt(gw[touched])).astype(np.float32)
                step = (moves - seen) / len(words)
                gt += step**2
                self.t -= 0.2 * step / np.sqrt(gt)
        self._forget()
        return self


def label_code(label: str | None) -> str | None:
    """The two-letter code that a label means; "" for a label that names some other language; None for none."""
    if label is None:
        return None
    bare = label.strip().lower()
    if not bare or bare in NO_LANGUAGE or not any(c.isalpha() for c in bare):
        return None
    if bare in _CODE:
        return _CODE[bare]
    first = re.split(r"[-_\s/,;.(]", bare)[0]
    return _CODE.get(first, None if first in NO_LANGUAGE else "")


def vote(words: list[str]) -> list[float]:
    """How much lexicon and scripts speak for each language: shared words count in parts."""
    out = [0.0] * len(LANGUAGES)
    for w in words:
        for lang in (langs := _IN.get(w, ())):
            out[LANGUAGES.index(lang)] += 1 / len(langs)
        script = _script(w)
        if script in ("hira", "kata"):
            out[LANGUAGES.index("ja")] += 1
        elif script == "cyrl":
            out[LANGUAGES.index("ru")] += 1
        elif script == "han":
            out[LANGUAGES.index("zh")] += 0.25
    return out


def train(rows: list[tuple[str, str]], seed: int = 7, per_language: int = 1000) -> Field:
    """Fits the field on (text, language code) pairs, of which some are wrong or mixed.

    A sentence keeps its document's label only where lexicon and scripts speak for it at least as much as for any other language; one
    for which they clearly speak otherwise changes sides; the rest is left out. The first fit on these sentences then labels all of
    the sample's, and a second one starts afresh from what it is sure of. The lexicon is part of the training, so that no
    language lacks examples.
    """
    seeds = [(words.split(), LANGUAGES.index(lang)) for lang, words in LEXICON.items()] * 3
    rng = np.random.default_rng(seed)
    pool, first = [], []
    for i in rng.permutation(len(rows)):
        text, code = rows[i]
        for _, words, full in sentences(text[:SAMPLE_CHARS]):
            if not full:
                continue
            words = words[:SENTENCE_WORDS]
            pool.append(words)
            votes = vote(words)
            best = max(votes)
            k = LANGUAGES.index(code) if code in LANGUAGES else -1
            if k < 0 or votes[k] < best or best <= 0:
                second = sorted(votes)[-2]
                k = votes.index(best) if best >= second + 1.5 else -1
            if k >= 0:
                first.append((words, k))

    def even(labelled):
        kept, n = [], [0] * len(LANGUAGES)
        for words, k in labelled:
            n[k] += 1
            if n[k] <= per_language:
                kept.append((words, k))
        return kept

    field = Field().fit(even(first) + seeds, epochs=2, seed=seed)
    pool = [pool[i] for i in rng.permutation(len(pool))[:SENTENCES]]
    sure = [(words, LANGUAGES.index(lang)) for words, ((lang, mean),) in zip(pool, field.label([[w] for w in pool])) if mean > 0.8]
    return Field().fit(even(sure) + seeds, epochs=2, seed=seed)


def _code_column(label: Column) -> Column:
    @F.pandas_udf("string")
    def code(s: pd.Series) -> pd.Series:
        known = {x: label_code(x) for x in s.dropna().unique()}
        return s.map(known).where(s.notna(), None)

    return code(label)


def sample(docs: DataFrame, key: str, text: str, label: str, total: int = SAMPLE, per_language: int = PER_LANGUAGE) -> list[tuple[str, str]]:
    """About ``total`` labelled texts, chosen by a hash of the key, their heads coming to the driver.

    Languages get their share of the corpus, because wrong labels then are the lesser part of each language's texts, but at least
    ``per_language`` where there are as many. Counts per label set the shares to take, so the number is bounded at every size of the corpus.
    """
    rows = docs.select(F.xxhash64(key).alias("h"), F.substring(text, 1, SAMPLE_CHARS).alias("t"), F.col(label).alias("l")).filter(F.length(F.trim("t")) > 20)
    counts: dict[str, int] = {}
    for raw, n in rows.groupBy("l").count().orderBy(F.desc("count")).limit(NOTATIONS).collect():  # notations, of which there are few
        if code := label_code(raw):
            counts[code] = counts.get(code, 0) + n
    if not counts:
        return []
    everywhere = min(1.0, total / sum(counts.values()))
    share = F.create_map(*[F.lit(x) for c, n in counts.items() for x in (c, min(1.0, max(everywhere, per_language / n)))])
    coded = rows.withColumn("c", _code_column(F.col("l"))).filter(F.col("c") != "")
    picked = coded.filter((F.pmod("h", F.lit(1 << 20)) / (1 << 20)) < F.try_element_at(share, F.col("c")))
    return [(r.t, r.c) for r in picked.select("h", "t", "c").orderBy("h", "t").limit(total + per_language * len(LANGUAGES)).collect()]


_fields: dict[str, Field] = {}


def fitted(docs: DataFrame, key: str, text: str, label: str) -> Field:
    """The field for a corpus: fitted on its :func:`sample` once and saved beside the sample's hash in the shared folder, then loaded."""
    rows = sample(docs, key, text, label)
    name = hashlib.sha256(repr((rows, BUCKETS, SENTENCE_WORDS, CHAIN_WORDS, SENTENCES, LEXICON)).encode("utf-8", "replace")).hexdigest()
    if name not in _fields:
        spark = docs.sparkSession
        saved = read_bytes(spark, f"fields/{name}")
        if saved is None:
            field = train(rows)
            held = io.BytesIO()
            np.savez(held, w=field.w, t=field.t)
            write_bytes(spark, f"fields/{name}", held.getvalue())
        else:
            field = Field()
            found = np.load(io.BytesIO(saved))
            field.w, field.t = found["w"], found["t"]
        if len(_fields) >= 4:
            _fields.clear()
        _fields[name] = field
    return _fields[name]


def segment(docs: DataFrame, key: str = "doc_id", text: str = "text", label: str = "lang", field: Field | None = None) -> DataFrame:
    """One row per document with prose and language in it: key, label_code, lang, sentences, full_sentences, confidence, chars, first.

    ``lang`` is a language of at least one sentence, with the number of its sentences, those that are full, the mean confidence, the
    characters and the place of its first sentence. Documents without prose, null, empty and blank texts give
    no rows; repeated rows give repeated rows; null keys stay null; texts are taken whole; other columns don't matter.
    The field is fitted on a bounded sample (about :data:`SAMPLE` documents) unless one is given.
    """
    if field is None:
        field = fitted(docs, key, text, label)
    shared = docs.sparkSession.sparkContext.broadcast(field)
    rows = spread(docs.select(key, text, label), key)
    kind = dict(rows.dtypes)[key]

    def run(batches):
        model = shared.value
        for pdf in batches:
            for start in range(0, len(pdf), 2000):
                part = pdf.iloc[start:start + 2000]
                found = [sentences(t) for t in part[text]]
                got = model.label([[w for _, w, _ in f] for f in found])
                out = []
                for k, raw, f, g in zip(part[key], part[label], found, got):
                    by: dict[str, list] = {}
                    for i, ((s, words, full), (lang, sure)) in enumerate(zip(f, g)):
                        row = by.setdefault(lang, [0, 0, 0.0, 0, i])
                        row[0] += 1
                        row[1] += full and sure >= MIN_CONFIDENCE
                        row[2] += sure
                        row[3] += len(s)
                    code = label_code(raw)
                    out += [(k, code, lang, r[0], int(r[1]), r[2] / r[0], r[3], r[4]) for lang, r in by.items()]
                yield pd.DataFrame(out, columns=[key, "label_code", "lang", "sentences", "full_sentences", "confidence", "chars", "first"])

    return rows.mapInPandas(run, f"`{key}` {kind}, label_code string, lang string, sentences int, full_sentences int, confidence double, chars long, first int")


def stretches(docs: DataFrame, key: str = "doc_id", text: str = "text", label: str = "lang", field: Field | None = None) -> DataFrame:
    """One row per maximal run of words of one language: key, label_code, segment, start, end, lang, words, confidence.

    Words take the language of their greatest marginal, so a stretch may begin and end within a sentence. ``segment`` counts a document's runs from 0,
    ``start`` and ``end`` are characters of the text as given, from the first word to behind the last, and ``confidence`` is the mean marginal. What isn't
    prose belongs to no run but doesn't end one either. Nulls, repeated rows and the field are treated as in :func:`segment`.
    """
    if field is None:
        field = fitted(docs, key, text, label)
    shared = docs.sparkSession.sparkContext.broadcast(field)
    rows = spread(docs.select(key, text, label), key)
    kind = dict(rows.dtypes)[key]

    def run(batches):
        model = shared.value
        for pdf in batches:
            for start in range(0, len(pdf), 2000):
                part = pdf.iloc[start:start + 2000]
                found = [[w for s in placed_words(t) for w in s] for t in part[text]]
                got = model.runs([[w for w, _, _ in f] for f in found])
                out = []
                for k, raw, f, g in zip(part[key], part[label], found, got):
                    code = label_code(raw)
                    out += [(k, code, n, f[a][1], f[b - 1][2], lang, b - a, sure) for n, (a, b, lang, sure) in enumerate(g)]
                yield pd.DataFrame(out, columns=[key, "label_code", "segment", "start", "end", "lang", "words", "confidence"])

    return rows.mapInPandas(run, f"`{key}` {kind}, label_code string, segment int, start int, end int, lang string, words int, confidence double")


def mislabelled(segments: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, lang, confidence) for documents whose label is absent, another language than their only one, or too simple.

    Only languages with a full sentence count. Documents are told apart by key, so repeated rows of one key are one document.
    """
    full = segments.filter("full_sentences > 0").groupBy(key, "lang").agg(F.max("label_code").alias("code"), F.max("confidence").alias("confidence"))
    # a document has at most as many rows here as there are languages
    per = full.groupBy(key).agg(F.collect_list(F.struct("lang", "confidence")).alias("__all"), F.count(F.lit(1)).alias("__n"), F.count_if(F.col("code") == F.col("lang")).alias("__right"))
    return per.filter((F.col("__n") > 1) | (F.col("__right") == 0)).select(key, F.inline("__all"))


def check_places(segments: DataFrame, lengths: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, good, inside) of each key of ``lengths`` (key, chars): whether its stretches are numbered without gaps, in order, apart and of a confidence in (0, 1], and whether they lie within the text.

    For keys that stand in one row each; others may have stretches of several texts.
    """
    w = Window.partitionBy(key).orderBy("segment")
    rows = segments.select(key, "segment", "start", "end", "confidence", F.lead("start").over(w).alias("next"), F.lead("segment").over(w).alias("after"))
    good = (F.col("start") < F.col("end")) & (F.col("start") >= 0) & (F.col("confidence") > 0) & (F.col("confidence") <= 1.0000001) & F.coalesce(F.col("next") >= F.col("end"), F.lit(True)) & F.coalesce(F.col("after") == F.col("segment") + 1, F.lit(True))
    per = rows.groupBy(F.col(key).alias("__k")).agg(F.count(F.lit(1)).alias("stretches"), F.bool_and(good).alias("good"), F.max("end").alias("last"))
    out = lengths.join(per, F.col(key) == F.col("__k"), "left")
    return out.select(key, F.coalesce("good", F.lit(True)).alias("good"), (F.coalesce("last", F.lit(0)) <= F.coalesce("chars", F.lit(0))).alias("inside"))
