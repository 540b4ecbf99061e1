"""Replay of migrations."""

from strataq.sources import sql_text as Q


def test_statements():
    text = "a 'x;y' /* ; /* ; */ */ b; -- c;\nDO $tag$ begin; end; $tag$; \"q;\""
    assert [" ".join(s.split()) for s in Q.statements(text)] == ["a 'x;y' b", "DO $tag$ begin; end; $tag$", '"q;"']


def test_replay(spark):
    m = [
        ("s", "2.sql", "ALTER TABLE users ADD COLUMN age int, DROP COLUMN name; ALTER TABLE users ALTER COLUMN email TYPE text USING email::text; DROP TABLE IF EXISTS gone; alter table nowhere add x int;"),
        ("s", "1.sql", "CREATE TABLE public.Users (id uuid PRIMARY KEY, name varchar(10) NOT NULL, email VARCHAR (99) unique, org int REFERENCES orgs(id), CONSTRAINT u UNIQUE (org));\ncreate table gone (x int); create table Users (z int);"
         'CREATE TABLE IF NOT EXISTS "Orgs" ("Id" "My Type", b numeric(10, 2) default 1, PRIMARY KEY ("Id", b));'),
        ("t", "1.sql", None),
    ]
    got = {(r.table, r.column): (r.type, r.optional, r.is_key, r.is_unique, r.references) for r in Q.schema_of(spark.createDataFrame(m, "scope_id string, path string, text string")).collect()}
    assert got == {
        ("users", "id"): ("uuid", False, True, False, None), ("users", "email"): ("text", True, False, True, None), ("users", "org"): ("int", True, False, True, "orgs"), ("users", "age"): ("int", True, False, False, None),
        ("Orgs", "Id"): ('"My Type"', False, True, False, None), ("Orgs", "b"): ("numeric(10, 2)", False, True, False, None),
    }
