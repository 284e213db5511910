"""URL filter: rules first, then logistic regression on hashed character n-grams of host and path.

The model is trained on the driver from a small labelled table (``SEED`` or the caller's, at
most ``MAX_TRAIN`` rows), hashed into 2**BITS weights, 2 MB to broadcast whatever the data.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import prepare

BITS, ORDERS, MAX_TRAIN = 18, (3, 4, 5), 100_000
#: The labelled table: addresses by what they are of, written for this module. ``example`` names no one.
_BLOCK = (
    # gambling
    "luckyspin-casino.example/slots/free-spins royal-casino.example/blackjack/bonus megaslots.example/casino/jackpot onlinepoker-room.example/poker/deposit-bonus "
    "sportsbet-live.example/betting/odds bingo-cash.example/bingo/welcome-bonus roulette-king.example/roulette/live 777slots.example/free-spins/no-deposit "
    "bet-and-win.example/betting/football pokerstarz.example/poker/tournament casino-affiliates.example/bonus/codes slotmachine-fun.example/slots/play "
    "cash-jackpot.example/jackpot/win cryptocasino.example/casino/dice lotto-tickets.example/lottery/buy-tickets gamblers-den.example/gambling/games "
    # adult
    "xxx-tube.example/porn/videos hotcams.example/live-sex/girls adultdate.example/hookup/tonight sexstories.example/erotic/stories "
    "nude-gallery.example/nudes/amateur milf-videos.example/porn/milf escorts-city.example/escort/services camgirls-live.example/webcam/girls "
    "fetish-club.example/fetish/videos sexychat.example/sex-chat/rooms pornhubster.example/porn/hd swingers.example/swinger/parties "
    "adult-toys.example/sex-toys/buy strip-live.example/webcam/strip hentai-world.example/hentai/manga onlynudes.example/nudes/leaked "
    # pills
    "cheap-pharmacy.example/buy-viagra/online pills4u.example/cialis/cheap no-prescription-meds.example/buy/xanax weightloss-miracle.example/diet-pills/buy "
    "canadian-pharma.example/viagra/generic steroids-shop.example/buy-steroids/oral tramadol-express.example/buy/tramadol male-enhancement.example/enlargement/pills "
    "rx-discount.example/pharmacy/no-prescription botox-cheap.example/buy/botox genericmeds.example/cialis/generic hairloss-cure.example/miracle/pills "
    "keto-gummies.example/weightloss/keto cbd-oils-cheap.example/buy-cbd/oil insulin-noscript.example/buy/no-prescription sleep-pills.example/buy/ambien "
    # piracy
    "crackedsoft.example/download/keygen warez-bb.example/cracked/software torrent-galaxy.example/torrent/movies free-serials.example/serial-keys/windows "
    "moviez-hd.example/watch-free/full-movie nulled-themes.example/nulled/wordpress mp3-downloadz.example/free-mp3/download crack-games.example/torrent/pc-games "
    "apk-modded.example/mod-apk/unlimited streamfree.example/watch-free/series keygen-store.example/keygen/office iptv-cheap.example/iptv/subscription "
    "rarbg-mirror.example/torrent/latest activator-kms.example/crack/activator romz.example/roms/download ebook-pirate.example/free-ebooks/torrent "
    # fraud
    "secure-login-verify.example/account/suspended paypa1-update.example/verify/account bank-alert.example/login/confirm-identity prize-winner.example/claim/your-reward "
    "free-giftcards.example/claim/gift-card iphone-giveaway.example/win/free-iphone crypto-doubler.example/double/bitcoin easy-money-home.example/earn/money-fast "
    "forex-signals.example/guaranteed/profit payday-loan-now.example/instant/approval-loan refund-tax.example/claim/refund wallet-connect-verify.example/verify/seed-phrase "
    "inheritance-fund.example/claim/funds survey-rewards.example/reward/claim-now bitcoin-profit-app.example/earn/bitcoin-profit apple-id-locked.example/verify/locked-account "
    # spam
    "seo-rank.example/buy-backlinks/cheap cheap-followers.example/buy-followers/instagram replica-rolex.example/replica/watches luxury-fakes.example/replica/handbags "
    "essay-mill.example/buy-essay/cheap clickbank-offers.example/affiliate/offer popunder-ads.example/adclick/redirect doorway-pages.example/cheap/discount-deals "
    "guestpost-seo.example/backlinks/guest-post traffic-bot.example/buy-traffic/cheap link-farm.example/links/buy-links email-blast.example/bulk-email/lists "
    "like-seller.example/buy-likes/cheap dissertation-4u.example/buy-essay/dissertation fake-diplomas.example/buy/diploma autoblog-spin.example/article/spinner "
)
_ALLOW = (
    # schools
    "www.northcollege.example/research/projects physics.lakeside.example/courses/mechanics library.eastschool.example/catalogue/books history.oldtown.example/lectures/medieval "
    "admissions.westfield.example/apply/undergraduate maths.riverside.example/notes/algebra chem.hillside.example/lab/safety alumni.parkview.example/news/reunion "
    "bio.seaside.example/papers/genetics www.primaryschool.example/parents/calendar law.citycollege.example/faculty/staff thesis.archive.example/2019/abstract "
    "geology.valley.example/field/trips music.conservatory.example/concerts/spring statistics.campus.example/seminar/bayes languages.institute.example/courses/spanish "
    # news
    "www.morningpaper.example/politics/election news.harbour.example/local/council daily.mountain.example/sport/cycling www.evening.example/world/europe "
    "regional.news.example/weather/storm press.riverbank.example/economy/inflation www.gazette.example/culture/theatre radio.valley.example/programmes/morning "
    "tv.coast.example/schedule/evening magazine.forest.example/features/interview zeitung.stadt.example/wirtschaft/energie journal.ville.example/societe/ecole "
    "diario.ciudad.example/cultura/cine www.weekly.example/opinion/letters news.science.example/space/telescope www.bulletin.example/archive/1998 "
    # public
    "www.citycouncil.example/services/recycling health.region.example/vaccination/centres tax.office.example/forms/income parks.county.example/trails/map "
    "transport.metro.example/timetable/line-4 police.district.example/report/lost-property museum.town.example/exhibitions/bronze court.state.example/rulings/2020 "
    "census.bureau.example/tables/population water.board.example/quality/report fire.service.example/safety/home library.county.example/opening/hours "
    "archive.national.example/records/letters meteo.service.example/forecast/week parliament.example/debates/minutes hospital.north.example/departments/cardiology "
    # computing
    "docs.toolkit.example/guide/install.html wiki.compiler.example/optimisation/passes forum.kernel.example/thread/10231 blog.database.example/2021/indexes "
    "api.service.example/reference/v2 www.editor.example/plugins/list code.project.example/issues/512 manual.shell.example/commands/find "
    "lists.devel.example/archive/2017-05 packages.distro.example/stable/utils learn.python.example/tutorial/functions bugs.tracker.example/show/9931 "
    "release.notes.example/changelog/3.4 spec.standard.example/draft/http robotics.club.example/projects/arm stats.language.example/packages/plots "
    # daily life
    "recipes.kitchen.example/soup/tomato www.gardening.example/plants/roses travel.guide.example/italy/rome hiking.club.example/routes/ridge "
    "knitting.circle.example/patterns/scarf birds.watch.example/species/heron www.bakery.example/menu/bread cycling.tours.example/france/loire "
    "parents.forum.example/toddlers/sleep cooking.blog.example/2018/lentils chess.club.example/results/league camping.sites.example/lakes/booking "
    "wood.workshop.example/joints/dovetail pets.advice.example/cats/feeding photo.album.example/landscapes/autumn weather.hobby.example/station/rain "
    # letters
    "poetry.archive.example/sonnets/18 www.booklovers.example/reviews/novel dictionary.words.example/etymology/bread philosophy.notes.example/kant/ethics "
    "classics.reader.example/odyssey/book-9 art.gallery.example/painters/vermeer film.society.example/programme/noir opera.house.example/season/verdi "
    "translation.guild.example/members/list folklore.tales.example/stories/fox linguistics.corner.example/syntax/trees essays.journal.example/issue/44 "
    "religion.studies.example/texts/psalms encyclopedia.example/wiki/renaissance theatre.company.example/tickets/hamlet blog.writer.example/2020/drafts "
)
#: (host, path, label), block = 1
SEED: list[tuple[str, str, int]] = [(h, "/" + p, y) for text, y in ((_BLOCK, 1), (_ALLOW, 0)) for h, _, p in (x.partition("/") for x in text.split())]
#: (verdict, rule); a rule is a host and the start of a path
RULES: tuple[tuple[str, str], ...] = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/ ? #`` or the end, A-Z lower-cased; else empty."""
    host = F.regexp_extract(F.coalesce(url.cast("string"), F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """After the host up to ``?`` or ``#`` or the end."""
    return F.regexp_extract(F.coalesce(url.cast("string"), F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def ruled(host: Column, path: Column, rules: tuple[tuple[str, str], ...] = RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, else nulls."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for v, r in sorted(rules, key=lambda x: len(x[1])):  # the longest is asked last, so wraps the others
        h, _, p = r.partition("/")
        fits = ((host == h) | host.endswith("." + h)) & path.startswith("/" + p)
        rule, verdict = F.when(fits, F.lit(r)).otherwise(rule), F.when(fits, F.lit(v)).otherwise(verdict)
    return rule, verdict


def features(host: str, path: str) -> np.ndarray:
    """Distinct hashed n-grams of host and path, each with a mark of which it is of."""
    out = []
    for kind, s in enumerate((host, path)):
        b = np.frombuffer(b"\x02" + s.encode("utf-8", "replace") + b"\x03", np.uint8).astype(np.uint64)
        for n in ORDERS:
            if len(b) >= n:
                with np.errstate(over="ignore"):
                    h = np.full(len(b) - n + 1, 2 * n + kind + 1, np.uint64)
                    for i in range(n):
                        h = (h ^ b[i : len(b) - n + 1 + i]) * np.uint64(0x100000001B3)
                        h ^= h >> np.uint64(29)
                out.append((h * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - BITS))
    return np.unique(np.concatenate(out)).astype(np.int64) if out else np.empty(0, np.int64)


def trained(rows: list[tuple[str, str, int]], rounds: int = 300, rate: float = 0.5, decay: float = 1e-3) -> tuple[np.ndarray, float]:
    """Weights and intercept; the intercept starts at allow, features are scaled by 1/sqrt(n)."""
    if len(rows) > MAX_TRAIN:  # a seeded sample, in the table's order
        rows = [rows[i] for i in np.sort(np.random.default_rng(1).choice(len(rows), MAX_TRAIN, replace=False))]
    w, bias = np.zeros(1 << BITS), -1.0
    xs = [features(h, p) for h, p, _ in rows]
    for _ in range(rounds):
        g, gb = np.zeros_like(w), 0.0
        for x, (_, _, y) in zip(xs, rows):
            k = 1 / np.sqrt(max(1, len(x)))
            e = 1 / (1 + np.exp(-(w[x].sum() * k + bias))) - y
            g[x] += e * k
            gb += e
        if rows:
            w -= rate * (g / len(rows) * 10 + decay * w)
            bias -= rate * 0.1 * gb / len(rows)
    return w.astype(np.float32), float(bias)


def chance(host: str, path: str, weights: np.ndarray, bias: float) -> float:
    x = features(host, path)
    z = float(weights[x].sum()) / np.sqrt(max(1, len(x))) + bias
    return float(1 / (1 + np.exp(-z)))


def judged(pages: DataFrame, labelled: list[tuple[str, str, int]] | None = None, rules: tuple[tuple[str, str], ...] = RULES, threshold: float = 0.5) -> DataFrame:
    """page_id, host, path, rule, verdict, score (chance of block by the model) for each row.

    Null urls and those without ``://`` have empty host and path and are allowed unless the model says
    otherwise. Equal urls get equal rows, repeated rows stay repeated; a url is read whole, however long; a null page_id
    stays; a chance of just ``threshold`` is block; other columns are ignored; without rows there is no result row.
    """
    spark = prepare(pages.sparkSession)
    shared = spark.sparkContext.broadcast(trained(SEED if labelled is None else labelled))
    own = pages.select(F.col("page_id").cast("long").alias("page_id"), host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, b = shared.value
        for part in parts:
            s = [chance(h, p, w, b) for h, p in zip(part.column(1).to_pylist(), part.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(s, pa.float64())], names=["page_id", "host", "path", "score"])

    scored = own.mapInArrow(run, "page_id long, host string, path string, score double")
    rule, verdict = ruled(F.col("host"), F.col("path"), rules)
    return scored.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, F.when(F.col("score") >= threshold, "block").otherwise("allow")).alias("verdict"), "score")
