"""The charset of bytes that declare none, by byte-pair statistics.

A model holds, for each charset, how likely each pair of neighbouring bytes is among the pairs with a byte beyond ASCII.
It is fitted from text: the text is encoded and its pairs counted, and pairs not seen get the share of their byte
classes. Bytes are taken to be in the charset that can decode them and makes their pairs most likely. fit() counts in
Spark over any table of texts; default_model() comes from the sentences below.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Bytes that may fail to decode, as a share of those beyond ASCII: a page can be cut in the middle of a character.
DAMAGED = 0.02
# The weight of byte classes against counted pairs, in pairs.
CLASS_WEIGHT = 400.0

_CHINESE = (
    "今天上午，市政府召开新闻发布会，介绍了今年经济发展的主要情况。记者从会上了解到，全市工业生产保持平稳增长，居民收入水平继续提高。"
    "有关部门负责人表示，下一步将加大对中小企业的支持力度，进一步改善营商环境。专家认为，这些措施对于推动科技创新具有重要意义。"
    "我们在网站上可以看到更多的文章和图片，欢迎大家留言讨论，如果有问题请联系编辑。"
)
_TRADITIONAL = (
    "今天上午，市政府召開新聞發布會，介紹了今年經濟發展的主要情況。記者從會上了解到，全市工業生產保持平穩增長，居民收入水平繼續提高。"
    "有關部門負責人表示，下一步將加大對中小企業的支持力度，進一步改善營商環境。專家認為，這些措施對於推動科技創新具有重要意義。"
    "我們在網站上可以看到更多的文章和圖片，歡迎大家留言討論，如果有問題請聯繫編輯。"
)
_JAPANESE = (
    "今日の午前、市役所で記者会見が開かれ、今年の経済の状況について説明がありました。工業生産は安定した伸びを続けており、"
    "住民の所得も上がっているということです。担当者は、これから中小企業への支援を強めていくと話しています。"
    "このサイトではニュースや写真をたくさん見ることができますので、ぜひコメントをお寄せください。インターネットのサービスとデータの利用もできます。"
)
_KOREAN = (
    "오늘 오전 시청에서 기자회견이 열려 올해 경제 상황에 대한 설명이 있었습니다. 공업 생산은 안정적으로 늘고 있으며 주민들의 소득도 오르고 있다고 합니다. "
    "담당자는 앞으로 중소기업에 대한 지원을 강화하겠다고 말했습니다. 이 사이트에서는 더 많은 기사와 사진을 볼 수 있으니 의견을 남겨 주시기 바랍니다."
)
_RUSSIAN = (
    "Сегодня утром в городской администрации прошла пресс-конференция, на которой рассказали об итогах года. Промышленное производство растёт, "
    "доходы жителей также увеличились. Представители ведомства сообщили, что поддержка малого бизнеса будет расширена. Эксперты считают, что эти меры "
    "имеют большое значение. На нашем сайте можно найти другие статьи и фотографии, а также оставить свой комментарий. Подробнее читайте в разделе Новости."
)
_GREEK = (
    "Σήμερα το πρωί έγινε στο δημαρχείο συνέντευξη τύπου για την πορεία της οικονομίας. Η βιομηχανική παραγωγή αυξάνεται σταθερά και τα εισοδήματα "
    "των κατοίκων ανεβαίνουν. Οι υπεύθυνοι δήλωσαν ότι θα ενισχύσουν τις μικρές επιχειρήσεις. Στην ιστοσελίδα μας θα βρείτε περισσότερα άρθρα και φωτογραφίες."
)
_WESTERN = (
    "Le café est situé à côté de l’hôtel de ville, où les élèves étaient déjà arrivés très tôt. Ça suffit, répondit-il; c’est «là-bas» que le garçon reçut sa leçon. "
    "Die Bürgermeisterin erklärte, daß für die Straße größere Beträge nötig wären; schöne Grüße aus München und Köln. Übrigens: Öffnungszeiten ändern sich häufig. "
    "El año pasado la situación económica mejoró, según explicó el señor Núñez; ¿qué pasará mañana? ¡Nadie lo sabía! La información está en la página de España. "
    "A situação é difícil, mas não há razão para preocupação; as crianças têm lições amanhã. Perché è così? La città è più bella di così, però già si può dire. "
    "Smörgåsbord på svenska är något för både små och stora; där får man äta. Blåbærsyltetøy smager godt på grød, også i København."
)

SAMPLES = [
    ("windows-1252", _WESTERN),
    ("gb18030", _CHINESE),
    ("big5", _TRADITIONAL),
    ("shift_jis", _JAPANESE),
    ("euc-jp", _JAPANESE),
    ("euc-kr", _KOREAN),
    ("windows-1251", _RUSSIAN),
    ("koi8-r", _RUSSIAN),
    ("windows-1253", _GREEK),
]

# Classes of bytes: letters, digits and the rest of ASCII, then eight bytes each.
_CLASS = np.array([0 if chr(b).isalpha() else 1 if chr(b).isdigit() else 2 if b <= 32 else 3 for b in range(128)] + [4 + (b - 128) // 8 for b in range(128, 256)])
_CLASSES = int(_CLASS.max()) + 1


def pair_counts(data: bytes) -> np.ndarray:
    """Counts of the 65,536 byte pairs of which one byte at least is beyond ASCII; both ends count as blanks."""
    b = np.frombuffer(b" " + data + b" ", np.uint8).astype(np.int32)
    pair = b[:-1] * 256 + b[1:]
    return np.bincount(pair[(b[:-1] >= 128) | (b[1:] >= 128)], minlength=65536)


@dataclass(frozen=True)
class CharsetModel:
    """Charsets, in the order in which equally likely ones are preferred, and the logarithm of each pair's share."""

    names: tuple[str, ...]
    log_share: np.ndarray

    @staticmethod
    def of_counts(counts: dict[str, np.ndarray]) -> CharsetModel:
        rows = []
        size = np.bincount(_CLASS, minlength=_CLASSES)
        cell = _CLASS[:, None] * _CLASSES + _CLASS[None, :]
        room = np.outer(size, size).reshape(-1)
        for n in counts.values():
            n = n.reshape(256, 256).astype(float)
            by_class = np.bincount(cell.reshape(-1), n.reshape(-1), _CLASSES**2) + 0.05
            expected = (by_class / by_class.sum() / room)[cell]
            rows.append(np.log((n + CLASS_WEIGHT * expected) / (n.sum() + CLASS_WEIGHT)).reshape(-1))
        return CharsetModel(tuple(counts), np.array(rows, np.float32))

    def guess(self, body: bytes) -> str | None:
        """The charset of body; None if it has no byte beyond ASCII."""
        counts = pair_counts(body)
        seen = np.flatnonzero(counts)
        if not len(seen):
            return None
        likely = self.log_share[:, seen] @ counts[seen].astype(np.float32)
        beyond = sum(c >= 128 for c in body) if len(body) < 64 else int((np.frombuffer(body, np.uint8) >= 128).sum())
        for i in np.argsort(-likely, kind="stable"):
            name = self.names[i]
            wrong = body.decode(name, errors="replace").count("�")
            if wrong <= DAMAGED * beyond + (beyond > 20):
                return "iso-8859-1" if name == "windows-1252" and not _has_c1(body) else name
        return "iso-8859-1"


def _has_c1(body: bytes) -> bool:
    b = np.frombuffer(body, np.uint8)
    return bool(((b >= 128) & (b < 160)).any())


@functools.cache
def default_model() -> CharsetModel:
    return CharsetModel.of_counts({name: pair_counts(text.encode(name, errors="ignore")) for name, text in SAMPLES})


def fit(samples: DataFrame, charset: str = "charset", text: str = "text") -> CharsetModel:
    """A model of the charsets that samples (charset, text) name, preferred in order of their names on ties.

    Pairs are counted in Spark, a partial count for each batch; at most 65,536 counts a charset come to the driver.
    Characters that a charset lacks are left out; null texts and charsets count nothing.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, texts in batch.groupby("charset")["text"]:
                n = sum((pair_counts(t.encode(name, errors="ignore")) for t in texts), np.zeros(65536, np.int64))
                seen = np.flatnonzero(n)
                yield pd.DataFrame({"charset": name, "pair": seen, "n": n[seen]})

    rows = samples.select(F.col(charset).alias("charset"), F.col(text).alias("text")).dropna()
    found = rows.mapInPandas(run, "charset string, pair int, n long").groupBy("charset", "pair").agg(F.sum("n").alias("n"))
    counts: dict[str, np.ndarray] = {}
    for r in found.orderBy("charset", "pair").collect():
        counts.setdefault(r.charset, np.zeros(65536, np.int64))[r.pair] = r.n
    return CharsetModel.of_counts(counts)


def guess_charset(body: Column, model: CharsetModel | None = None) -> Column:
    """The charset whose byte pairs body resembles; NULL for NULL and for bytes within ASCII."""
    chosen = model or default_model()

    @F.pandas_udf(StringType())
    def guessed(bodies: pd.Series) -> pd.Series:
        return bodies.map(lambda b: None if b is None else chosen.guess(bytes(b)))

    return guessed(body)
