"""Labelled lines from which the quality rules are learned: written by rule here, none from the corpus.

Prose in seven languages, as written, without case and punctuation, wrapped, quoted or spoken; and lists, tables,
records, logs, code and junk over the same words.
"""

from __future__ import annotations

import base64
import json
import random
import textwrap

#: Sentences with places for names and numbers.
SENTENCES = {
    "en": (
        "When {n} came back from the village, nobody asked why the door had been left open.",
        "It is easier to write a long letter than to explain it over the phone, said {n}.",
        "She was told that the train would leave at {d}, but it was still there an hour later.",
        "We have not decided if the money should go to {n} or to the people who asked first.",
        "Most of them were tired, and there was little to eat after they had crossed the river.",
        "Could you tell me how this machine works before {n} takes it apart again?",
        "In the evening they would sit by the fire and talk about what they had seen.",
        "The old bridge was closed for {d} days because some of its stones had moved.",
        "{n} sold the brass clock. Tall reeds hide the pond near {n}.",
        "Every morning {n} feeds {d} geese. Later the miller laughed.",
        "What did {n} bury behind the barn? The grey horse stood still.",
    ),
    "de": (
        "Als {n} aus dem Dorf zurückkam, fragte niemand, warum die Tür offen war.",
        "Es ist nicht leicht, einen Brief zu schreiben, wenn man nicht weiß, wer ihn lesen wird.",
        "Wir haben noch nicht entschieden, ob das Geld an {n} oder an die anderen gehen soll.",
        "Die alte Brücke war {d} Tage geschlossen, weil sich einige Steine bewegt hatten.",
        "Am Abend saßen sie am Feuer und sprachen über das, was sie gesehen hatten.",
    ),
    "fr": (
        "Quand {n} est revenue du village, personne n'a demandé pourquoi la porte était ouverte.",
        "Il est plus facile d'écrire une lettre que de l'expliquer au téléphone, dit {n}.",
        "Nous n'avons pas encore décidé si cet argent doit aller à {n} ou aux autres.",
        "Le vieux pont est resté fermé pendant {d} jours parce que des pierres avaient bougé.",
        "Le soir, ils parlaient près du feu de ce qu'ils avaient vu pendant la journée.",
    ),
    "es": (
        "Cuando {n} volvió del pueblo, nadie preguntó por qué la puerta estaba abierta.",
        "Es más fácil escribir una carta que explicarla por teléfono, dijo {n}.",
        "Todavía no hemos decidido si el dinero debe ser para {n} o para los demás.",
        "El viejo puente estuvo cerrado {d} días porque algunas piedras se habían movido.",
        "Por la noche hablaban junto al fuego de lo que habían visto durante el día.",
    ),
    "ja": (
        "{n}が村から帰ってきた時、なぜ戸が開いていたのかを誰も聞きませんでした。",
        "電話で説明するより、長い手紙を書くほうが簡単だと思います。",
        "汽車は{d}時に出るはずでしたが、一時間後もまだそこにありました。",
        "お金を{n}に渡すのか、ほかの人に渡すのか、まだ決めていない。",
        "夕方になると、みんなは火のそばに座って、見てきたことを話した。",
        "古い橋は石が動いたので、{d}日のあいだ閉まっていました。",
        "この機械がどう動くのか、分解する前に教えてくれませんか？",
        "やがて{n}は灰色の馬を売った。{n}の水車小屋には窓が{d}枚ある。",
    ),
    "zh": (
        "{n}从村子里回来的时候，没有人问门为什么开着。",
        "写一封长信比在电话里说明要容易，这是我的想法。",
        "火车本来应该在{d}点离开，可是一个小时以后它还在那里。",
        "我们还没有决定这笔钱是给{n}，还是给别的人。",
        "晚上他们坐在火边，说起了白天看到的事情。",
        "因为有几块石头动了，那座老桥关了{d}天。",
        "后来{n}卖掉铜钟。{n}的磨坊共有{d}扇窗。",
    ),
    "ko": (
        "{n}이 마을에서 돌아왔을 때 왜 문이 열려 있었는지 아무도 묻지 않았습니다.",
        "전화로 설명하는 것보다 긴 편지를 쓰는 것이 더 쉽다고 생각해요.",
        "기차는 {d}시에 떠날 예정이었지만 한 시간 뒤에도 그대로 있었다.",
        "그 돈을 {n}에게 줄지 다른 사람들에게 줄지 아직 정하지 못했습니다.",
        "저녁이 되면 모두 불 옆에 앉아서 그날 본 것을 이야기했어요.",
    ),
}

#: Things that lists and tables name.
THINGS = {
    "en": "the copper kettle|a spare wheel|winter boots|the north gate|that wooden box|paper lamp|the third floor|garden tools|an old radio|blue glass|the ticket office|salt and pepper|this week|a loud noise|the last page|goat cheese|a wall of bricks",
    "de": "der Kupferkessel|ein Ersatzrad|die Winterstiefel|das Nordtor|die Holzkiste|alte Radios|das blaue Glas|der dritte Stock|auf dem Dach|vor dem Haus|im Keller|die neue Lampe",
    "fr": "la bouilloire en cuivre|une roue de secours|les bottes d'hiver|la porte du nord|le verre bleu|le troisième étage|la caisse|dans la cour|sur le pont|à la ferme|devant un four",
    "es": "la tetera de cobre|una rueda|las botas de invierno|la puerta norte|el vidrio azul|el tercer piso|la caja de madera|en la cocina|frente a un muro|la nueva silla",
    "ja": "銅のやかん|予備のタイヤ|冬の長靴|北門|木の箱|紙の明かり|三階|庭の道具|古いラジオ|青いガラス|切符売り場|ヤギのチーズ|割れた皿|入口の音",
    "zh": "铜水壶|备用的轮子|冬天的靴子|北门|那个木箱|纸灯|三楼|园艺工具|旧收音机|蓝色的玻璃|售票处|破掉的盘子|最后一页",
    "ko": "구리 주전자|예비 바퀴|겨울 장화|북쪽 문|나무 상자|종이 등|삼층|정원 도구|낡은 라디오|파란 유리|깨진 접시",
}

NAMES = "Marlen Oskari Tibold Yanaro Feldis Kuoma Beresi Ulvan Rossi 林田 佐和子 王明 김철수".split()
SPEAKERS = "MARLEN OSKARI YANARO Narrator 先生 店員 旁人 선생님".split()


def _sentence(r: random.Random, lang: str) -> str:
    return r.choice(SENTENCES[lang]).format(n=r.choice(NAMES), d=r.randint(2, 400))


#: How two sentences are joined into a longer one.
JOINTS = {"en": ", and ", "de": ", und ", "fr": ", et ", "es": ", y ", "ja": "、そして", "zh": "，而且", "ko": ", 그리고 "}


def _long_or_short(r: random.Random, lang: str) -> str:
    s = _sentence(r, lang)
    if r.random() < 0.3:
        t = _sentence(r, lang)
        s = s[:-1] + JOINTS[lang] + t[0].lower() + t[1:]
    return s


def _prose(r: random.Random, lang: str) -> list[str]:
    spaced = lang not in ("ja", "zh")
    text = (" " if spaced else "").join(_long_or_short(r, lang) for _ in range(r.randint(1, 12)))
    if r.random() < 0.35:  # signs that stray into prose
        cuts = sorted(r.sample(range(len(text)), min(len(text), r.randint(1, 6))))
        stray = ("**", "_", " ☆ ", "※", " #", "[1]", " <b>", "</b> ", " 🎤", " & ", "[x] ", "@", " → ", "*", "㍿", " | ", "~")
        text = "".join(a + b for a, b in zip((text[i:j] for i, j in zip([0, *cuts], [*cuts, len(text)])), [*(r.choice(stray) for _ in cuts), ""]))
    if r.random() < 0.1:
        text = text.upper()
    way = r.randrange(9)
    if way in (0, 7):
        text = "".join(c for c in text.lower() if c.isalnum() or c in " '")
    if way == 1:
        return [f"{r.choice(SPEAKERS)}{r.choice([': ', '：'])}{_sentence(r, lang)}" for _ in range(r.randint(2, 8))]
    if way >= 4:
        return [r.choice(["", "", "", "", "- ", "# "]) + text]
    width = r.randint(24, 90)
    lines = textwrap.wrap(text, width) if spaced else [text[i : i + width // 2] for i in range(0, len(text), width // 2)]
    return ["> " + x for x in lines] if way == 3 else lines


def _junk(r: random.Random, lang: str) -> list[str]:
    things = THINGS[lang].split("|")
    pick = lambda: r.choice(things)
    word = lambda: r.choice(r.choice(THINGS["en"].split("|")).split())
    hexes = lambda n: "".join(r.choice("0123456789abcdef") for _ in range(n))
    code = ("for i in range(n):", "    total += rows[i].size", "if (x != null && x.ok()) { return x; }", "import os, sys", "SELECT id, name FROM t WHERE n > 3;", "def load(path, *, mode='r'):", "    return json.loads(f.read())", "const a = await fetch(url);", "}", "#include <stdio.h>", "int main(void) { return 0; }", "print(f'{a} is not in {b}')")
    n = r.randint(4, 14)
    number = lambda: f"{r.uniform(-90, 90):.{r.randint(0, 3)}f}"
    kinds = [
        lambda: [pick() for _ in range(n)],
        lambda: [f"{r.choice('-*•・+')} {pick()}" for _ in range(n)],
        lambda: [f"{o}{i}{c} {pick()}" for o, c in [r.choice([("", "."), ("(", ")"), ("[", "]"), ("", ")")])] for i in range(1, n)],
        lambda: [f"[{r.choice(' x')}] {pick()}" for _ in range(n)],
        lambda: [f"{pick()} {'.' * r.randint(5, 40)} {r.randint(1, 400)}" for _ in range(n)],
        lambda: [f"{word()}{r.choice(':=：')} {r.choice([pick(), str(r.randint(1, 9999)), word()])}" for _ in range(n)],
        lambda: [s.join([f"{word()}_{r.randint(1, 999)}.dat", str(r.randint(1, 99999)), word(), pick(), number()]) for s in [r.choice([",", "\t", " | ", ";"])] for _ in range(n)],
        lambda: [f"| {word()} | {r.randint(1, 9999)} | {pick()} | {number()} |" for _ in range(n)] + ["|---|---|---|---|"],
        lambda: [f"2024-0{r.randint(1, 9)}-1{r.randint(0, 9)} 0{r.randint(0, 9)}:{r.randint(10, 59)}:{r.randint(10, 59)} {r.choice(['INFO', 'WARN', 'ERROR'])} {word()}-{r.randint(1, 9)} {word()} code={r.randint(1, 300)}" for _ in range(n)],
        lambda: [f"{i * 16:08x}  " + " ".join(hexes(2) for _ in range(16)) for i in range(n)],
        lambda: [base64.b64encode(r.randbytes(r.choice([45, 300]))).decode() for _ in range(r.randint(1, 8))],
        lambda: [json.dumps([{"id": r.randint(1, 999999), word(): word(), "h": hexes(12), "ok": True} for _ in range(r.randint(1, 8))])],
        lambda: [f'<div class="{word()}{r.randint(1, 99)}"><a href="/{word()}/{hexes(6)}">{r.choice(["", word()])}</a></div>' for _ in range(n)],
        lambda: [" ".join(number() for _ in range(8)) for _ in range(n)],
        lambda: ["".join(r.choice("★□◆%^&*#@<>|~_=+ ♪→↑") for _ in range(r.randint(1, 30))) for _ in range(n)],
        lambda: [" ".join([x] * 30) for x in [pick()]],
        lambda: [" ".join(word() for _ in range(r.randint(20, 60)))],
        lambda: [r.choice([" ", ", ", "、", " / ", " | ", "; ", " - "]).join(pick() for _ in range(r.randint(3, 50)))],
        lambda: [r.choice(["ー", "笑", "哈", "w", "=", "あ", "ㅋ", "x", "。"][:8]) * r.randint(4, 150) for _ in range(r.randint(1, 3))],
        lambda: [pick() for _ in range(r.randint(2, 40))],
        lambda: ["".join(r.choice("abcdefghijklmnopqrstuvwxyz    ;") for _ in range(r.randint(20, 400)))],
        lambda: [r.choice(code) for _ in range(n)],
        lambda: [f"{word()}_{word()}_{r.randint(1, 99999):05d}.{r.choice(['wav', 'flac', 'txt'])}" for _ in range(n)],
        lambda: [f"https://example.org/{word()}/{word()}?{word()}={r.randint(1, 99)}" for _ in range(n)],
        lambda: [" > ".join(word() for _ in range(5)), " | ".join(word() for _ in range(7))],
        lambda: [_sentence(r, lang).encode().decode("latin-1")],
    ]
    return r.choice(kinds)()


def labelled_documents(documents: int = 2400, seed: int = 7) -> list[tuple[list[str], bool]]:
    """``(lines, is prose)`` of so many documents, half of them prose; repeatable."""
    r = random.Random(seed)
    langs = list(SENTENCES)
    return [((_prose if i % 2 == 0 else _junk)(r, r.choice(langs)), i % 2 == 0) for i in range(documents)]
