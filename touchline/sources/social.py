"""Posts of four networks in one shape.  Replies, sensitive posts and accounts
that opted out are dropped here."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from touchline.functions import text as T
from touchline.operators.social import blocked

TEXT_LIMIT, BODY_LIMIT, MEDIA_LIMIT = 1200, 600, 4  # fixed values of the post shape
MASTODON = ("uri string, url string, content string, created_at string, language string, sensitive boolean, spoiler_text string, visibility string, in_reply_to_id string, "
            "reblog string, favourites_count bigint, reblogs_count bigint, replies_count bigint, account struct<username:string,acct:string,display_name:string,avatar:string,"
            "avatar_static:string,url:string,noindex:boolean,discoverable:boolean>, media_attachments array<struct<type:string,preview_url:string,description:string>>")
_LABELS = "array<struct<val:string>>"
BLUESKY = (f"uri string, author struct<handle:string,displayName:string,avatar:string,labels:{_LABELS}>, record struct<text:string,createdAt:string,langs:array<string>,reply:string>, "
           f"labels {_LABELS}, likeCount bigint, repostCount bigint, replyCount bigint, embed struct<images:array<struct<thumb:string,alt:string>>,media:struct<images:array<struct<thumb:string,alt:string>>>>")
REDDIT = ("id string, title string, selftext string, author string, permalink string, created_utc double, over_18 boolean, stickied boolean, thumbnail string, score bigint, num_comments bigint")
ATOM = ("id string, title string, link struct<_href:string>, author struct<name:string,uri:string>, published string, updated string, content string, "
        "`media:thumbnail` struct<_url:string>")
X = ("id string, text string, created_at string, lang string, possibly_sensitive boolean, public_metrics struct<like_count:bigint,retweet_count:bigint,reply_count:bigint>, "
     "user struct<name:string,username:string,profile_image_url:string>")


def _s(c: str | Column) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def _no(c: str) -> Column:
    return ~F.coalesce(F.col(c), F.lit(False))


def _post(df: DataFrame, network: str, **cols: Column) -> DataFrame:
    zero = F.lit(0).cast("long")
    base = {"id": None, "url": None, "author_name": None, "author_handle": None, "author_avatar": F.lit(""), "author_url": None, "text": None, "created_at": None, "ts": None,
            "lang": F.lit(""), "likes": zero, "reposts": zero, "replies": zero, "media": F.array().cast("array<struct<thumb:string,alt:string>>")}
    base.update(cols)
    return df.select(F.lit(network).alias("network"), *[v.alias(k) for k, v in base.items()])


def _images(c: Column, thumb: str, alt: str, keep=None) -> Column:
    arr = F.coalesce(c, F.array().cast(c_type(thumb, alt, keep)))
    kept = F.filter(arr, keep) if keep is not None else arr
    return F.slice(F.transform(kept, lambda m: F.struct(_s(m[thumb]).alias("thumb"), _s(m[alt]).alias("alt"))), 1, MEDIA_LIMIT)


def c_type(thumb: str, alt: str, keep) -> str:
    kind = "type:string," if keep is not None else ""
    return f"array<struct<{kind}{thumb}:string,{alt}:string>>"


def mastodon(raw: DataFrame) -> DataFrame:
    ok = (_no("sensitive") & (_s("spoiler_text") == "") & (F.col("visibility") == "public") & (_s("in_reply_to_id") == "") & F.col("reblog").isNull()
          & _no("account.noindex") & F.coalesce("account.discoverable", F.lit(True)))
    p = raw.filter(ok).withColumn("plain", T.plain_text("content")).filter("plain <> ''")
    pics = _images(F.col("media_attachments"), "preview_url", "description", lambda m: (m["type"] == "image") & (_s(m["preview_url"]) != ""))
    return _post(p, "mastodon", id=F.concat(F.lit("mastodon:"), "uri"), url=F.coalesce("url", "uri"), author_name=F.coalesce(F.nullif("account.display_name", F.lit("")), _s("account.username")),
                 author_handle=F.concat(F.lit("@"), _s("account.acct")), author_avatar=F.coalesce("account.avatar_static", "account.avatar", F.lit("")), author_url=_s("account.url"),
                 text=F.substring("plain", 1, TEXT_LIMIT), created_at=_s("created_at"), ts=T.epoch_seconds(F.col("created_at")), lang=_s("language"),
                 likes=F.coalesce("favourites_count", F.lit(0)), reposts=F.coalesce("reblogs_count", F.lit(0)), replies=F.coalesce("replies_count", F.lit(0)), media=pics)


def bluesky(raw: DataFrame) -> DataFrame:
    none = F.array().cast(_LABELS)
    labels = F.transform(F.concat(F.coalesce("labels", none), F.coalesce("author.labels", none)), lambda x: _s(x["val"]))
    p = raw.filter(~blocked(labels) & F.col("record.reply").isNull()).withColumn("body", F.trim(_s("record.text"))).filter("body <> ''")
    handle = _s("author.handle")
    profile = F.concat(F.lit("https://bsky.app/profile/"), handle)
    return _post(p, "bluesky", id=F.concat(F.lit("bluesky:"), "uri"), url=F.concat(profile, F.lit("/post/"), F.substring_index("uri", "/", -1)),
                 author_name=F.coalesce(F.nullif("author.displayName", F.lit("")), handle), author_handle=F.concat(F.lit("@"), handle), author_avatar=_s("author.avatar"), author_url=profile,
                 text=F.substring("body", 1, TEXT_LIMIT), created_at=_s("record.createdAt"), ts=T.epoch_seconds(F.col("record.createdAt")),
                 lang=_s(F.try_element_at("record.langs", F.lit(1))), likes=F.coalesce("likeCount", F.lit(0)), reposts=F.coalesce("repostCount", F.lit(0)),
                 replies=F.coalesce("replyCount", F.lit(0)), media=_images(F.coalesce("embed.images", "embed.media.images"), "thumb", "alt"))


def _thumb(url: Column, alt: Column) -> Column:
    none = F.array().cast("array<struct<thumb:string,alt:string>>")
    return F.when(url.startswith("https://"), F.array(F.struct(url.alias("thumb"), alt.alias("alt")))).otherwise(none)


def reddit(raw: DataFrame) -> DataFrame:
    p = raw.filter(_no("over_18") & _no("stickied") & (_s("title") != ""))
    body, user = F.trim(_s("selftext")), F.concat(F.lit("u/"), _s("author"))
    at = F.coalesce("created_utc", F.lit(0.0))
    return _post(p, "reddit", id=F.concat(F.lit("reddit:t3_"), "id"), url=F.concat(F.lit("https://www.reddit.com"), _s("permalink")), author_name=user, author_handle=user,
                 author_url=F.concat(F.lit("https://www.reddit.com/user/"), _s("author")), text=F.concat("title", F.when(body != "", F.concat(F.lit("\n\n"), F.substring(body, 1, BODY_LIMIT))).otherwise("")),
                 created_at=F.date_format(F.timestamp_seconds(at), "yyyy-MM-dd'T'HH:mm:ssXXX"), ts=at, lang=F.lit("en"), likes=F.coalesce("score", F.lit(0)),
                 replies=F.coalesce("num_comments", F.lit(0)), media=_thumb(_s("thumbnail"), F.col("title")))


def reddit_atom(raw: DataFrame) -> DataFrame:
    """Entries of the public feed; a link post carries the article's address."""
    title, url, author = F.trim(_s("title")), _s("link._href"), F.trim(_s("author.name"))
    p = raw.filter((title != "") & (url != "") & (author != ""))
    links = F.filter(F.regexp_extract_all(_s("content"), F.lit('href="(https?://[^"]+)"'), F.lit(1)), lambda u: ~u.contains("reddit.com") & ~u.contains("redd.it"))
    handle = F.when(author.startswith("/u/"), F.substr(author, F.lit(2))).otherwise(F.concat(F.lit("u/"), author))
    when = F.coalesce("published", "updated", F.lit(""))
    first = F.try_element_at(links, F.lit(1))
    return _post(p, "reddit", id=F.concat(F.lit("reddit:"), F.coalesce("id", url)), url=url, author_name=handle, author_handle=handle, author_url=F.trim(_s("author.uri")),
                 text=F.concat(title, F.when(first.isNotNull(), F.concat(F.lit("\n\n"), first)).otherwise("")), created_at=when, ts=T.epoch_seconds(when), lang=F.lit("en"),
                 media=_thumb(_s(F.col("`media:thumbnail`._url")), title))


def x(raw: DataFrame) -> DataFrame:
    p = raw.filter(_no("possibly_sensitive"))
    name = _s("user.username")
    return _post(p, "x", id=F.concat(F.lit("x:"), "id"), url=F.concat(F.lit("https://x.com/"), F.when(name == "", "i").otherwise(name), F.lit("/status/"), "id"),
                 author_name=F.coalesce("user.name", name), author_handle=F.concat(F.lit("@"), name), author_avatar=_s("user.profile_image_url"), author_url=F.concat(F.lit("https://x.com/"), name),
                 text=_s("text"), created_at=_s("created_at"), ts=T.epoch_seconds(F.col("created_at")), lang=_s("lang"), likes=F.coalesce("public_metrics.like_count", F.lit(0)),
                 reposts=F.coalesce("public_metrics.retweet_count", F.lit(0)), replies=F.coalesce("public_metrics.reply_count", F.lit(0)))
