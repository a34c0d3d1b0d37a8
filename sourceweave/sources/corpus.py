"""A source-code corpus written by one SQL expression over the star tables.

The given tables hold no source code, so each supplier becomes a small web
application (FastAPI, Flask, Django or ORM modules, a React page, Express,
Spring, Go), each part becomes a Python utility module and each nation becomes
a project with its manifests. The same SQL text runs on Spark and on the
checking engine, and the corpus grows with the tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sourceweave.session import dealt


def _sql_text(template: str) -> str:
    """Turn a template with ``<<expr>>`` holes into a SQL ``concat``."""
    parts = []
    for piece_no, piece in enumerate(template.lstrip("\n").replace("<<", "\0").replace(">>", "\0").split("\0")):
        if piece_no % 2:
            parts.append(f"cast({piece} as string)")
        elif piece:
            parts.append("'" + piece.replace("'", "''") + "'")
    return "concat(" + ", ".join(parts) + ")"


_FASTAPI = '''
import os
import redis
from typing import List, Optional
from fastapi import APIRouter, Depends
from backend.models.model_<<k>> import Sup<<k>>
from lib.util_<<n>> import helper_<<n>>, fmt_<<n>> as fmt
from .shared import tool_<<k % 7>>

router = APIRouter(prefix="/sup<<k>>")
cache = redis.Redis(host="cache<<k % 5>>.local", port=63<<k % 90 + 10>>)
LIMIT = <<k % 50>>


@router.get("/items", response_model=ItemOut, tags=["items", "sup<<k % 3>>"])
async def list_items_<<k>>(
    page: int = 1,
    query: Optional[str] = None,
):
    """List items of supplier <<k>>."""
    rows = load_<<k>>(page)
    return fmt(rows)


@router.post("/items")
@audit(level=<<k % 4>>)
def create_item_<<k>>(data: ItemIn, user=Depends(get_current_user)):
    """
    Create one item.
    """
    check_<<k>>(data)
    return load_<<k>>(helper_<<n>>(data.id))


@app.delete("/items/{item_id}")
async def delete_item_<<k>>(item_id: str, current_user: User):
    return await remove_<<k>>(item_id)


def load_<<k>>(page, size=20):
    key = "rows:" + str(page)
    if cache.get(key):
        return cache.get(key)
    return Store<<k>>.find(page)


def check_<<k>>(data):
    load_<<k>>(1)


class Store<<k>>(BaseStore, Mixin):
    """Row store."""

    table = "store_<<k>>"

    def __init__(self, url: str = "db"):
        self.url = url

    @staticmethod
    def find(page: int) -> List[int]:
        return check_<<k>>(page)

    def save(self, *rows, **opts) -> None:
        for row in rows:
            self.push(row)
'''

_FLASK = '''
from flask import Flask, request
import logging
import jwt

logger = logging.getLogger("web<<k>>")
app = Flask("web<<k>>")
SECRET = "s<<k>>"


@app.route("/web<<k>>", methods=["GET", "POST"])
@login_required
def index_<<k>>():
    """Index page <<k>>."""
    return render(request.args)


@bp.route("/web<<k>>/report", methods=["PUT"])
def report_<<k>>():
    token = jwt.encode({"sub": <<k>>}, SECRET)
    return index_<<k>>()


def render(args):
    return str(args)
'''

_SQLALCHEMY = '''
from sqlalchemy import Column, ForeignKey, Integer, String
from sqlalchemy.orm import relationship
from backend.db import Base


class Sup<<k>>(Base):
    __tablename__ = "sup_<<k>>"

    id = Column(Integer, primary_key=True)
    name = Column(String, nullable=False)
    nation_id = Column(Integer, ForeignKey("nation_<<n>>.id"))
    status = Column(String(20), default="new")
    note = Column(Text, nullable=True)
    orders = relationship("Order<<k>>")

    def label(self):
        return self.name


class Log<<k>>(Base):
    id = Column(Integer, primary_key=True)
    body = Column(Text)


DEFAULT_<<k>> = Sup<<k>>
'''

_DJANGO = '''
from django.db import models


class Book<<k>>(models.Model):
    title = models.CharField(max_length=100)
    pages = models.IntegerField(null=True, blank=True)
    code = models.SlugField(primary_key=True)

    def short(self):
        return self.title
'''

_REACT = '''
import React, { useState, useEffect as onMount } from "react";
import { BrowserRouter, Route } from "react-router-dom";
import * as api from "./client_<<k>>";
import axios from "axios";

const BASE_URL = "https://api<<k % 4>>.example.com";

export async function loadRows<<k>>(page) {
  const res = await fetch("/api/sup<<k>>/items", { method: "POST", body: JSON.stringify({ page: page }) });
  const more = await axios.get("/api/sup<<k>>/more", { params: { page: 1, size: 20 } });
  return api.post("sup<<k>>/save", { data: { name: more } });
}

const SupPage<<k>> = (props) => {
  const [items, setItems] = useState([]);
  const [open, setOpen] = useState(false);
  const theme = useSelector(selectTheme);
  const save = () => http.put("/api/sup<<k>>/items/1", {
    body: { id: <<k>>, name: "x" },
  });
  return (
    <form onSubmit={handleSubmit<<k>>}>
      <button onClick={handleDelete<<k>>}>x</button>
      <button onClick={() => setOpen(true)}>open</button>
      <Link to="/sup<<k>>/detail">go</Link>
      <BrowserRouter>
        <Route path="/" element={<HomePage />} />
        <Route path="/sup<<k>>" element={<SupPage<<k>> />} />
        <Route path="/sup<<k>>/detail" element={<DetailView />} />
        <Route path="/sup<<k>>/detail/edit" element={<EditPage />} />
      </BrowserRouter>
    </form>
  );
};

function handleSubmit<<k>>(event) {
  navigate("/done<<k % 3>>");
  loadRows<<k>>(1);
}
'''

_VUE = '''
import { createRouter } from "vue-router";

export const routes = [
  { path: "/home<<k>>", component: HomeView },
  { path: "/user<<k>>/list", name: "UserListPage" },
];
const client = createClient({ baseURL: "https://vue<<k % 4>>.example.com" });
$.get("/legacy/<<k>>");
'''

_EXPRESS = '''
const express = require("express");
const winston = require("winston");
const app = express();

app.use(winston.logger);

// List orders
app.get("/orders<<k>>", function listOrders<<k>>(req, res) {
  res.send(findOrders<<k>>(req));
});

/* Save order */
router.post("/orders<<k>>",
  async (req, res) => {
    setTimeout(done, 10);
  });

const findOrders<<k>> = (req) => {
  return db.query(req);
};

class Cart<<k>> extends Base {
  add(item) {
    this.items.push(item);
  }
}
'''

_TYPEORM = '''
import { Entity, Column } from "typeorm";

export interface Shape<<k>> {
  id: number;
  label?: string;
}

@Entity("item_<<k>>")
@Index(["title"])
export class Item<<k>> extends BaseItem {
  @PrimaryGeneratedColumn() id: number;
  @Column({ nullable: true }) title: string;
  @Column() price: number;

  total(qty: number, rate: number = 2): number {
    return this.price * qty;
  }
}

@Entity("piece_<<k>>")
export class Piece<<k>> {
  @PrimaryGeneratedColumn() id: number;
}

function scale<<k>>(a: number, b: number): number {
  return a * b;
}
'''

_MONGOOSE = '''
const mongoose = require("mongoose");

const User<<k>>Schema = new Schema({
  name: { type: String },
  age: { type: Number },
});
const User<<k>> = mongoose.model("users_<<k>>", User<<k>>Schema);
'''

_PRISMA = '''
datasource db { provider = "postgresql" }
// prisma schema <<k>>
model Account<<k>> {
  id Int @id
  email String
  name String?
  // note
  @@index([email])
}
'''

_SPRING = '''
package com.example.sup<<k>>;

import java.util.List;
import org.springframework.web.bind.annotation.GetMapping;

@RestController
public class Ctl<<k>> extends BaseCtl implements Api {
    private final Repo repo;

    /**
     * Find all rows.
     */
    @GetMapping("/sup<<k>>")
    public List findAll(int page, String query) {
        return repo.load(page);
    }

    @PostMapping("/sup<<k>>/new")
    public Row create(Row row) {
        check(row);
        return repo.save(row);
    }

    private void check(Row row) {
        LoggerFactory.getLogger(Ctl<<k>>.class).info("x");
    }

    Row load(int page) {
        return repo.load(page);
    }

    public <T> T first(List<T> rows) {
        return rows.get(0);
    }
}
'''

_GO = '''
package svc<<k>>

import "fmt"
import "net/http"

type Server<<k>> struct {
	Port int
}

func (s *Server<<k>>) Start(addr string, n int) error {
	fmt.Println(addr)
	return http.ListenAndServe(addr, nil)
}

func Run<<k>>() {
	fmt.Println("run")
}

type Pair<<k>>[K comparable, V any] struct {
	Key K
}

func (p *Pair<<k>>[K, V]) First(n int) K {
	return p.Key
}

func Map<<k>>[T any](items []T) int {
	return len(items)
}
'''

_PAGE_NEXT = '''
import { useRouter } from "next/router";

export default function Home<<k>>() {
  const router = useRouter();
  router.push("/next<<k>>");
}
'''

_UTIL = '''
import json
from lib.util_<<hub>> import helper_<<hub>>
<<link>>

SIZE_<<k>> = <<k % 100>>


def helper_<<k>>(value, scale: int = <<k % 9>>):
    """Scale a value."""

    def inner(x):
        return fmt_<<k>>(x)

    return inner(value) * scale


def fmt_<<k>>(value) -> str:
    # plain text
    text = json.dumps(value)
    return text + helper_<<hub>>(value)


async def main_<<k>>():
    helper_<<k>>(1)
    await push(fmt_<<k>>(2), "<<p_name>>")
'''

# Texts that only a reader of tokens gets right: code in strings and comments, heads over lines.
_TRAP_PY = '''
"""Reads of supplier <<k>>.

class of things
def nothing(x):
import nowhere
x = 1
"""
import io
from typing import Dict
import re as patterns


@cached(
    size=<<k % 9>>,
    note=") def no():",
)
class Reader<<k>>(Base[Dict, int], Mixin, metaclass=Meta):
    # class Hidden: pass
    """Reads (one) supplier."""

    marks = "a { b"  # def z(
    sizes: Dict[str, int] = {}

    def fetch(self, a="x,)y", b: Dict[str, int] = {}, *rest) -> Dict[str, int]:
        # first a comment, then the text
        """Fetch: one (or more)."""
        text = """
def inner(q):
    return lost(q)
"""
        return send<<k>>(a, pack("p(q", [1, <<k>>]), key=lambda t: t)  # lost(1)

    def last(
        self,
        more: Dict[str, int],
    ):
        return self.fetch(
            more,
            [x for x in range(<<k>>)],
        )


def send<<k>>(*parts): return parts
'''

_TRAP_TS = '''
/* class Hidden { */
export class Store<<k>><T extends Row> extends Base<T, string> implements Keeps<T>, Sized {
  private rows: T[];
  label?: string;
  // load(x) {
  get(id: string,
      mark = "}"): Promise<Map<string, number> > {
    const open = "{ no block";
    const rule = this.find(/[{(]/g, `x{ mark`);
    return this.load(id, { a: 1, b: [2, <<k>>] });
  }
  load(a: Map<string, number>, b = { c: 1 }): void {
    check(a, (x) => x > <<k>>);
  }
}
'''

_TRAP_JAVA = '''
package com.example.trap<<k>>;

import java.util.Map;

@Service
public class Trap<<k>>
        extends Base<String, Row>
        implements Api<Row>, Closeable {
    private final Map<String, Integer> counts = new HashMap<>();
    int first, second = <<k>>;
    @Inject Repo repo;

    public Map<String, List<Row> > multi(
            Map<String, Integer> sizes,
            int n) throws IOException {
        String brace = "}"; // }
        char mark = '{';
        return repo.load("a, b", pick(n, <<k>>));
    }

    void after() { multi(null, 1); }
}
'''

_TRAP_GO = '''
package trap<<k>>

import (
	"fmt"
	store "example.com/store"
)

/* func hidden() { */
type Doer<<k>> interface {
	Do(a int, sizes map[string]int) error
}

type Trap<<k>> struct {
	Name, Alias string `json:"name"`
	Sizes map[string]int // {
	*Base
	store.Conn
}

func (t *Trap<<k>>) Do(
	a int,
	sizes map[string]int,
) error {
	fmt.Println("{", `raw {`, sizes["a"])
	return t.run(a, <<k>>)
}
'''

_TRAP_JS = '''
import "./side_<<k>>";
import first, { second as other } from "./both_<<k>>";
// an open bracket in a comment ( or in a string is none
const mark<<k>> = "(";
let total = sum(1, 2); // of all
function broken<<k>>(a {
  return a;
}
'''

_PACKAGE_JSON = '''
{
  "name": "web-<<n>>",
  "dependencies": { "react": "^18.<<n>>.0", "axios": "1.<<n>>.0", "@scope/kit/sub": "2.0.0" },
  "devDependencies": { "express": "4.<<n>>.0", "typescript": "" }
}
'''

_REQUIREMENTS = '''
# web
fastapi==0.<<n>>.0
redis>=4.<<n>>
-r base.txt
typing
sqlalchemy
'''

_PYPROJECT = '''
[project]
requires-python = "python"
dependencies = ["httpx>=0.<<n>>", "rich[all] ~=13.<<n>>", "wheel", "redis"]
'''

_GOMOD = '''
module example.com/svc
go 1.21
require github.com/pkg/errors v0.<<n>>.1
require (
	golang.org/x/net v0.<<n>>.0
)
'''

_POM = '''
<project xmlns="http://maven.apache.org/POM/4.0.0">
  <dependencies>
    <dependency><groupId>org.spring</groupId><artifactId>web</artifactId><version>5.<<n>></version></dependency>
    <dependency><artifactId>lone</artifactId></dependency>
  </dependencies>
</project>
'''

_README = '''
# Project <<n_name>>

Service for region <<r>>.
'''

# A part module imports its ring neighbour when its block of 100 is a multiple
# of 300; other blocks form acyclic chains, and every module imports a hub.
_NEXT = "(case when (p_partkey - p_partkey % 25) % 100 = 75 then p_partkey - 75 else p_partkey + 25 end)"
_LINK = (
    "(case when (p_partkey - p_partkey % 100) % 300 = 0 or (p_partkey - p_partkey % 25) % 100 <> 75 then "
    f"concat('from lib.util_', cast({_NEXT} as string), ' import fmt_', cast({_NEXT} as string)) else 'import csv' end)"
)

_SUPPLIER_FILES = [
    ("backend/api/sup_<<k>>.py", _FASTAPI),
    ("backend/web/flask_<<k>>.py", _FLASK),
    ("backend/models/model_<<k>>.py", _SQLALCHEMY),
    ("backend/books/book_<<k>>.py", _DJANGO),
    ("frontend/src/SupPage<<k>>.tsx", _REACT),
    ("frontend/src/router_<<k>>.ts", _VUE),
    ("frontend/pages/home<<k>>.tsx", _PAGE_NEXT),
    ("server/app_<<k>>.js", _EXPRESS),
    ("server/item_<<k>>.ts", _TYPEORM),
    ("server/user_<<k>>.js", _MONGOOSE),
    ("server/schema_<<k>>.prisma", _PRISMA),
    ("java/src/Ctl<<k>>.java", _SPRING),
    ("cmd/svc_<<k>>.go", _GO),
    ("frontend/node_modules/lib<<k>>/index.js", _EXPRESS),
    ("tools/reader_<<k>>.py", _TRAP_PY),
    ("tools/store_<<k>>.ts", _TRAP_TS),
    ("tools/Trap<<k>>.java", _TRAP_JAVA),
    ("tools/trap_<<k>>.go", _TRAP_GO),
    ("tools/broken_<<k>>.js", _TRAP_JS),
]
_NATION_FILES = [
    ("package.json", _PACKAGE_JSON),
    ("requirements.txt", _REQUIREMENTS),
    ("pyproject.toml", _PYPROJECT),
    ("go.mod", _GOMOD),
    ("java/pom.xml", _POM),
    ("README.md", _README),
]


# Columns of each table that fill the holes of its templates.
_TABLES = {
    "supplier": ("s_nationkey", {"k": "s_suppkey", "n": "s_nationkey"}, _SUPPLIER_FILES),
    "nation": (
        "n_nationkey",
        {"n": "n_nationkey", "n_name": "n_name", "r": "n_regionkey"},
        _NATION_FILES,
    ),
    "part": (
        "p_partkey % 25",
        {"k": "p_partkey", "hub": "p_partkey % 25", "link": _LINK, "p_name": "p_name"},
        [("lib/util_<<k>>.py", _UTIL)],
    ),
}


_COLUMNS = ["s_suppkey", "s_nationkey", "n_nationkey", "n_name", "n_regionkey", "p_partkey", "p_name"]


def _file_exprs(table: str) -> tuple[str, list[tuple[str, str]]]:
    """SQL of the project id and of (path, content) for each file of one table."""
    project, names, files = _TABLES[table]

    def named(text: str) -> str:
        for hole, expr in names.items():
            text = text.replace(f"<<{hole}>>", f"<<{expr}>>").replace(f"<<{hole} ", f"<<{expr} ")
        return _sql_text(text)

    return f"concat('p', cast({project} as string))", [(named(p), named(t)) for p, t in files]


def corpus_sql() -> str:
    """The corpus as portable SQL, for the checking engine."""
    return "\nunion all ".join(
        f"select {project} as project_id, {path} as path, {content} as content from {table}"
        for table in _TABLES
        for project, files in [_file_exprs(table)]
        for path, content in files
    )


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``files(project_id, path, content)``; one row per file.

    Only the key rows of the three tables are united (and spread over the
    cores); the texts are written afterwards in one narrow pass.
    """
    keys = None
    for name in _TABLES:
        columns = [c for c in _COLUMNS if c.startswith(name[0] + "_")]
        rows = spark.read.parquet(f"{sf_dir}/{name}.parquet").select(F.lit(name).alias("origin"), *columns)
        keys = rows if keys is None else keys.unionByName(rows, allowMissingColumns=True)
    project, files = "case origin", "case origin"
    for name in _TABLES:
        project_sql, exprs = _file_exprs(name)
        structs = ", ".join(f"named_struct('path', {p}, 'content', {c})" for p, c in exprs)
        project += f" when '{name}' then {project_sql}"
        files += f" when '{name}' then array({structs})"
    rows = dealt(keys, *[c for c in _COLUMNS if c.endswith("key")])
    return rows.selectExpr(f"{project} end as project_id", f"inline_outer({files} end)")
