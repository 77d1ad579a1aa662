"""The default URL vocabulary: one line a theme, ``class weight: terms``.

Written for this engine.  ``read`` takes the same form from any text, so a table of one's
own can be given to ``judge_urls``; a weight counts for soft terms only.
"""

from __future__ import annotations

DEFAULT = """
strict 1: adult casino casinos escort escorts hentai milf nude nudes porn porno pornstar sexcam xxx
strict 1: viagra cialis levitra tramadol xanax steroids
strict 1: malware phishing keylogger ransomware botnet carding fullz spyware
strict 1: warez keygen nulled cracked serialz
strict 1: doorway linkfarm spamfarm
soft 1: spam farm seo backlink backlinks clickbait doorways
soft 1: bet bets betting bingo gambling jackpot lottery poker roulette slots wager
soft 1: pills pharmacy pharma rx diet slimming
soft 1: crack torrent torrents hack hacks cheats apk mod
soft 1: loan loans payday forex crypto bitcoin mlm
soft 1: sex sexy erotic dating hookup lingerie
soft 1: tracker tracking popup popups affiliate affiliates ad ads adserver doubleclick
soft 1: win winner prize prizes giveaway bonus
soft 0.5: free cheap cheapest discount discounts deal deals sale coupon coupons promo buy
soft 0.5: click track redirect landing offer offers
soft 0.5: replica fake clone
"""


def read(text: str = DEFAULT) -> tuple[dict[str, float], dict[str, float]]:
    """(strict, soft): term -> weight.  A term stands in one class; its first line counts."""
    out: dict[str, dict[str, float]] = {"strict": {}, "soft": {}}
    for line in filter(str.strip, text.splitlines()):
        head, terms = line.split(":")
        kind, weight = head.split()
        for t in terms.lower().split():
            if not any(t in known for known in out.values()):
                out[kind][t] = float(weight)
    return out["strict"], out["soft"]
