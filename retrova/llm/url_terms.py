"""The weighted URL vocabulary by category: one strict term rejects a URL, soft ones have weights."""

from __future__ import annotations

import csv

STRICT_BY_CATEGORY = {
    "adult": "adult adultery amateurporn bdsm blowjob boobs bukkake camgirl camgirls camsex cumshot deepthroat escort escorts erotica fetish fisting gangbang handjob hardcore hentai hotsex livecam livesex milf milfs naked nsfw nude nudes nudist onlyfans orgasm orgy porn pornhub porno pornstar pornstars sexcam sexcams sexchat sexshop sextape sextoys striptease swingers threesome upskirt xxx youporn",
    "gambling": "baccarat blackjack bookmaker bookmakers casino casinos craps jackpots poker roulette slotmachine sportsbook sportsbooks videopoker",
    "pharmacy": "adipex ambien buy-cialis buy-viagra cheap-meds cheap-pills cialis hydrocodone kamagra levitra modafinil onlinepharmacy oxycodone oxycontin phentermine tramadol valium viagra vicodin xanax",
    "malware": "botnet cracked exploit-kit keygen keygens keylogger malware phishing ransomware rootkit serialz spyware trojan warez",
    "spam": "backlinks-cheap doorway-page instant-loan link-farm linkfarm linkfarms payday-loan payday-loans paydayloan paydayloans spam-farm spamfarm splog",
    "tracking": "adserver adservers adtrack clickbank doubleclick popunder",
    "piracy": "1080p-free camrip dvdrip free-movies-online putlocker streamrip torrents webrip yify",
}
SOFT_BY_CATEGORY = {
    "adult": {"cam": 1.0, "cams": 1.0, "dating": 1.0, "flirt": 1.0, "girls": 1.0, "hookup": 1.5, "hot": 0.5, "lingerie": 1.0, "love": 0.5, "sex": 2.0, "sexy": 1.5, "singles": 1.0, "teen": 1.0, "teens": 1.0},
    "gambling": {"bet": 1.5, "bets": 2.0, "betting": 2.0, "bingo": 1.5, "bonus": 1.0, "gamble": 2.0, "gambling": 2.0, "jackpot": 1.5, "lottery": 1.5, "lotto": 1.5, "odds": 1.0, "slot": 1.0, "slots": 1.5, "spins": 1.0, "wager": 1.5, "win": 1.0, "winner": 1.0},
    "pharmacy": {"diet": 0.5, "drug": 0.5, "drugs": 0.5, "meds": 1.0, "pharmacy": 1.0, "pill": 1.0, "pills": 1.5, "prescription": 0.5, "rx": 1.0, "weightloss": 1.5},
    "malware": {"crack": 1.5, "cracks": 1.5, "exploit": 1.0, "hack": 1.0, "hacks": 1.0, "patch": 0.5, "serial": 1.0, "torrent": 1.5, "virus": 1.0},
    "spam": {"affiliate": 1.0, "backlink": 1.5, "backlinks": 1.5, "buy": 1.0, "cash": 1.0, "cheap": 1.0, "cheapest": 1.0, "click": 1.0, "coupon": 1.0, "coupons": 1.0, "credit": 0.5, "crypto": 0.5, "deal": 1.0, "deals": 1.0, "discount": 1.0, "discounts": 1.0, "earn": 1.0, "farm": 0.5, "free": 1.0, "freebies": 1.5, "giveaway": 1.0, "loan": 1.0, "loans": 1.0, "money": 0.5, "offer": 0.5, "offers": 0.5, "promo": 1.0, "replica": 1.5, "sale": 1.0, "seo": 1.0, "spam": 1.5},
    "tracking": {"ad": 1.0, "ads": 1.5, "banner": 1.0, "pixel": 0.5, "popup": 1.0, "sponsored": 1.0, "track": 1.5, "tracker": 1.5, "tracking": 1.5},
    "feeds": {"feed": 0.5, "fbclid": 0.5, "gclid": 0.5, "ref": 0.5, "utm_campaign": 0.5, "utm_medium": 0.5, "utm_source": 0.5},
}

STRICT = tuple(sorted({t for terms in STRICT_BY_CATEGORY.values() for t in terms.split()}))
SOFT = {t: w for terms in SOFT_BY_CATEGORY.values() for t, w in terms.items()}


def load(path: str) -> tuple[tuple[str, ...], dict[str, float]]:
    """Strict and soft terms of a table of one's own: tab-separated lines (category, term, weight), the weight empty for strict terms."""
    strict, soft = set(), {}
    with open(path, encoding="utf-8", newline="") as f:
        for _, term, weight in csv.reader(f, delimiter="\t"):
            if weight.strip():
                soft[term] = float(weight)
            else:
                strict.add(term)
    return tuple(sorted(strict)), soft
