import pytest

from feedloom.operators import validate as va

ARTICLE = ("source_id string, original struct<title:string,summary:string,content:string,url:string,"
           "published_at:string,image:string,author:string>, language string")
GOOD = ("s", ("t", "s", "c", "https://a.b", None, "", ""), "en")


def messages(df, issues):
    row = va.with_errors(df, issues).first()
    return [(e.path, e.message) for e in row.errors]


@pytest.mark.parametrize("change, expected", [
    ({}, []),
    ({"source_id": ""}, [("sourceId", "Source ID is required")]),
    ({"source_id": None}, [("sourceId", "Required")]),
    ({"title": ""}, [("original.title", "Original title is required")]),
    ({"title": " "}, []),
    ({"summary": ""}, [("original.summary", "Original summary is required")]),
    ({"content": ""}, [("original.content", "Original content is required")]),
    ({"url": "a b"}, [("original.url", "Original URL must be valid")]),
    ({"date": "2026-07-16T06:00:00Z"}, []),
    ({"date": "Thu, 16 Jul 2026 06:00:00 GMT"}, [("original.publishedAt", "Invalid datetime")]),
    ({"language": ""}, [("language", "String must contain at least 1 character(s)")]),
    ({"language": "x" * 10}, []),
    ({"language": "x" * 11}, [("language", "String must contain at most 10 character(s)")]),
    ({"language": None}, []),
    ({"title": "", "url": ""}, [("original.title", "Original title is required"), ("original.url", "Original URL must be valid")]),
])
def test_new_article(spark, change, expected):
    v = {"source_id": "s", "title": "t", "summary": "s", "content": "c", "url": "https://a.b", "date": None, "language": "en"} | change
    row = (v["source_id"], (v["title"], v["summary"], v["content"], v["url"], v["date"], "", ""), v["language"])
    assert messages(spark.createDataFrame([row], ARTICLE), va.article_issues()) == expected


SOURCE = ("name string, type string, url string, priority int, fetch_interval int, language string, fetch_strategy string")


@pytest.mark.parametrize("change, expected", [
    ({}, []),
    ({"priority": None, "fetch_interval": None, "language": None, "fetch_strategy": None}, []),
    ({"name": ""}, [("name", "Name is required")]),
    ({"type": None}, [("type", "Type is required")]),
    ({"type": "ATOM"}, [("type", "Invalid enum value. Expected 'RSS' | 'API', received 'ATOM'")]),
    ({"url": "x"}, [("url", "Must be a valid URL")]),
    ({"url": None}, [("url", "Required")]),
    ({"priority": 0}, [("priority", "Priority must be >= 1")]),
    ({"fetch_interval": 0}, [("fetchInterval", "fetchInterval must be > 0")]),
    ({"fetch_strategy": "SOME"},
     [("fetchStrategy", "Invalid enum value. Expected 'RSS_ONLY' | 'RSS_PLUS_HTML_FETCH' | 'AUTO', received 'SOME'")]),
])
def test_new_source(spark, change, expected):
    v = {"name": "n", "type": "RSS", "url": "https://a.b", "priority": 1, "fetch_interval": 1, "language": "en",
         "fetch_strategy": "AUTO"} | change
    assert messages(spark.createDataFrame([tuple(v.values())], SOURCE), va.source_issues()) == expected


PATCH = ("fields array<string>, slug string, tags array<string>, language string, author string, cover_image string, "
         "status string, ai struct<token_usage:struct<input:long,output:long,total:long>>")


@pytest.mark.parametrize("fields, change, expected", [
    ([], {"slug": "", "status": "x"}, []),
    (["slug"], {"slug": ""}, [("slug", "String must contain at least 1 character(s)")]),
    (["slug"], {}, [("slug", "Expected string, received null")]),
    (["category_id", "published_at"], {}, []),
    (["tags"], {}, [("tags", "Expected array, received null")]),
    (["status"], {"status": "PENDING"},
     [("status", "Invalid enum value. Expected 'RAW' | 'NORMALIZED' | 'AI_PROCESSING' | 'PENDING_REVIEW' | 'APPROVED' | "
                 "'PUBLISHED' | 'REJECTED' | 'ARCHIVED', received 'PENDING'")]),
    (["ai"], {"ai": ((-1, 0, 5),)}, [("ai.tokenUsage.input", "Number must be greater than or equal to 0")]),
])
def test_article_patch(spark, fields, change, expected):
    v = dict.fromkeys(("slug", "tags", "language", "author", "cover_image", "status", "ai")) | change
    df = spark.createDataFrame([(fields, *v.values())], PATCH)
    assert messages(df, va.article_patch_issues(has_ai=True)) == expected


def test_source_patch(spark):
    schema = ("fields array<string>, name string, type string, url string, status string, priority int, fetch_interval int, "
              "language string, description string, fetch_strategy string")
    rows = [(["status", "priority"], None, None, None, "PAUSED", 0, None, None, None, None),
            (["fetch_strategy"], None, None, None, None, None, None, None, None, "RSS_ONLY"),
            (["description"], None, None, None, None, None, None, None, None, None)]
    out = [[(e.path, e.message) for e in r.errors]
           for r in va.with_errors(spark.createDataFrame(rows, schema), va.source_patch_issues()).collect()]
    assert out == [[("status", "Invalid enum value. Expected 'ACTIVE' | 'INACTIVE', received 'PAUSED'"),
                    ("priority", "Priority must be >= 1")], [], [("description", "Expected string, received null")]]


def test_messages_group_by_path(spark):
    df = spark.createDataFrame([([("a", "1"), ("b", "2"), ("a", "3")],)], "errors array<struct<path:string,message:string>>")
    assert va.rejected_rows(df).first().details == {"a": ["1", "3"], "b": ["2"]}


def test_ids_and_not_found(spark):
    ids = spark.createDataFrame([("",), ("a",)], "id string")
    assert [len(r.errors) for r in va.with_errors(ids, va.id_issues("Article")).collect()] == [1, 0]
    row = va.not_found(ids.filter("id = 'a'"), "Source").first()
    assert (row.message, row.error_code, row.status_code) == ("Source with id 'a' not found", "NOT_FOUND", 404)
    codes = {c: va.with_code(ids, c).first().status_code for c in
             ("VALIDATION_ERROR", "INFRASTRUCTURE_ERROR", "CONTENT_FETCH_ERROR", "INTERNAL_ERROR")}
    assert codes == {"VALIDATION_ERROR": 400, "INFRASTRUCTURE_ERROR": 502, "CONTENT_FETCH_ERROR": 502, "INTERNAL_ERROR": 500}
