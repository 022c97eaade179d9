"""Sinks: data as JSON and text, reports as HTML. Only bounded reports go through the driver."""

from __future__ import annotations

import html
import json
import re
import uuid
from collections.abc import Iterator, Sequence
from datetime import datetime
from urllib.parse import quote

import pandas as pd
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema
from ..operators import stats as S
from ..session import file_exists, put_text, spread, stored
from .readers import asset

#: Items that one self-contained page can hold.
MAX_ITEMS = 50_000


def results_json(sents: DataFrame, ents: DataFrame, keys: Sequence[str], path: str, mode: str = "errorifexists", input_file: str | None = None) -> None:
    """A JSON object for each text: input_file (a column of sents, or the keys), total_sentences, total_entities and the sentences with their entities."""
    by = [*keys, "sent_no"]
    e = ents.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("ent_no", "text", F.col("type_ru").alias("type")))).alias("e"))
    rows = sents.join(e, by, "left").withColumn("e", F.coalesce(F.transform("e", lambda x: F.struct(x["text"].alias("text"), x["type"].alias("type"))), F.array().cast("array<struct<text:string,type:string>>")))
    one = F.struct("sent_no", "sentence", F.col("e").alias("entities"))
    named = F.first(input_file) if input_file else F.concat_ws("/", *[F.first(F.col(k).cast("string")) for k in keys])
    out = rows.groupBy(*keys).agg(named.alias("input_file"), F.count("*").alias("total_sentences"), F.sum(F.size("e")).alias("total_entities"), F.array_sort(F.collect_list(one)).alias("results"))
    out.write.mode(mode).json(path)


def dataset_json(samples: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Samples (tokens, tags) as JSON arrays, one in each file: what readers.labelled() reads."""

    def arrays(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        before = "["
        for batch in batches:
            lines = []
            for x in batch["j"]:
                lines.append(before)
                before = f"{x},"
            yield pd.DataFrame({"value": lines})
        yield pd.DataFrame({"value": ["[]"] if before == "[" else [before[:-1], "]"]})

    rows = samples.select(F.to_json(F.struct("tokens", "tags")).alias("j"))
    rows.mapInPandas(arrays, "value string").write.mode(mode).text(path)


def row_files(df: DataFrame, path: str, name: str, text: str = "text") -> list[str]:
    """A text file for each row, with a line's end behind the text, in a folder for each task under the URI path; returns the folders (path alone without rows).

    A file is called <place in its task>-<name>.txt, so rows of one name keep files of
    their own. A folder is in the result once all its files are closed; what a task that
    failed has left is not. The store must be one that pyarrow opens.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = pafs.FileSystem.from_uri(path)
        at, folder = 0, f"part-{uuid.uuid4().hex}"
        for batch in batches:
            if at == 0:
                store.create_dir(f"{root}/{folder}")
            for called, body in zip(batch.column(0), batch.column(1)):
                with store.open_output_stream(f"{root}/{folder}/{at:08d}-{quote(called.as_py() or '', safe='=')}.txt") as out:
                    if body.is_valid:
                        out.write(body.as_buffer())
                    out.write(b"\n")
                at += 1
        if at:
            yield pa.RecordBatch.from_pydict({"folder": [folder]})

    rows = spread(df.select(F.col(name).cast("string").alias("name"), F.col(text).cast("binary").alias("body")))
    store, root = pafs.FileSystem.from_uri(path)
    store.create_dir(root)
    return [f"{path}/{r['folder']}" for r in rows.mapInArrow(write, "folder string").collect()] or [path]  # a row a task


def vocabulary_text(vocab: DataFrame, path: str, mode: str = "errorifexists", files: int = 1) -> None:
    """Tokens by id, one a line: in one file, as models have it, or in several, which readers.vocabulary() numbers in the order of their names."""
    dealt = vocab.repartition(1) if files == 1 else vocab.repartitionByRange(files, "id")
    dealt.sortWithinPartitions("id").select("token").write.mode(mode).text(path)


def item_rows(items: DataFrame) -> DataFrame:
    """(original_order, html) of search items: built in the row, quotes and markup escaped everywhere."""

    def esc(c):
        for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
            c = F.replace(c, F.lit(a), F.lit(b))
        return c

    text, kind = esc(F.col("text")), esc(F.col("type_ru"))
    where = F.array_join(F.transform("sentences", lambda s: F.concat(F.lit("<li>"), esc(s["sentence"]), F.lit("</li>"))), "")
    row = F.concat(
        F.lit('<details class="item" data-original-order="'), F.col("original_order").cast("string"), F.lit('" data-type="'), kind, F.lit('" data-text="'), text, F.lit('"><summary>'),
        text, F.lit(" ("), kind, F.lit(") × "), F.col("amount").cast("string"), F.lit("</summary><ol>"), where, F.lit("</ol></details>"),
    )
    return items.select("original_order", row.alias("html"))


_PAGE = """<!DOCTYPE html><html lang="ru"><head><meta charset="utf-8"><title>{title}</title>
<style>body{{font-family:sans-serif;margin:2rem}}.item,.card{{border:1px solid #ccc;padding:.5rem;margin:.5rem 0}}mark{{background:#fd6}}[hidden]{{display:none}}</style>
</head><body>{body}<script>{script}</script></body></html>"""

_SEARCH = """
const box=document.getElementById('needle'),kind=document.getElementById('kind'),list=document.getElementById('results');
const items=[...list.querySelectorAll('.item')];
function show(){
  const t=box.value.trim().toLowerCase(),k=kind.value;
  const rank=i=>{const x=i.dataset.text.toLowerCase();if(k&&i.dataset.type!==k)return 3;if(!t)return 2;return x===t?0:x.includes(t)?1:3};
  items.map(i=>[rank(i),+i.dataset.originalOrder,i]).sort((a,b)=>a[0]-b[0]||a[1]-b[1]).forEach(([r,,i])=>{i.hidden=r===3;list.append(i)});
}
box.oninput=kind.onchange=show;
"""


def _guard(spark: SparkSession, target: str, overwrite: bool) -> str:
    if not overwrite and file_exists(spark, target):
        raise FileExistsError(target)
    return target


def search_page(items: DataFrame, folder: str, overwrite: bool = False, style: str | None = None, script: str | None = None) -> str:
    """list.html: a self-contained page that searches up to MAX_ITEMS items; search_site() takes any number.

    style and script name files that go into the page beside its own; missing ones count as empty.
    """
    spark = items.sparkSession
    target = _guard(spark, f"{folder}/list.html", overwrite)
    if items.count() > MAX_ITEMS:
        raise ValueError(f"more than {MAX_ITEMS} items; write search_site()")
    rows = "".join(r["html"] for r in item_rows(items).orderBy("original_order").toLocalIterator())
    kinds = "".join(f"<option>{html.escape(r['type_ru'])}</option>" for r in items.select("type_ru").distinct().orderBy("type_ru").collect())
    body = f'<style>{asset(style)}</style><input id="needle"><select id="kind"><option value=""></option>{kinds}</select><div id="results">{rows}</div>'
    put_text(spark, target, _PAGE.format(title="Члены предложений", body=body, script=_SEARCH + asset(script)), overwrite)
    return target


def item_pages(items: DataFrame, path: str, per_page: int = 1000, mode: str = "errorifexists") -> None:
    """The same items as pages of per_page each, in folders page=0, page=1, …; a task holds one page at a time."""
    head, tail = _PAGE.format(title="Члены предложений", body="\0", script="").split("\0")
    paged = item_rows(items).withColumn("page", F.floor(F.col("original_order") / per_page))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("original_order", "html"))), lambda x: x["html"]), "")
    whole = paged.groupBy("page").agg(F.concat(F.lit(head), body, F.lit(tail)).alias("value"))
    whole.write.mode(mode).partitionBy("page").text(path)


_SITE = """
let hits=[],open_=null;
const box=document.getElementById('needle'),kind=document.getElementById('kind'),list=document.getElementById('results'),said=document.getElementById('said');
const load=f=>new Promise(r=>{const s=document.createElement('script');s.src=f;s.onload=s.onerror=()=>{s.remove();r()};document.head.append(s)});
let onItem=()=>{},onContext=()=>{};
function i(...x){onItem(...x)}
function c(...x){onContext(...x)}
async function search(){
  const t=box.value.trim().toLowerCase(),k=kind.value;hits=[];
  onContext=()=>{};
  onItem=(order,text,type,amount)=>{const x=text.toLowerCase();if(k&&type!==k)return;const r=!t?2:x===t?0:x.includes(t)?1:3;if(r<3)hits.push([r,order,text,type,amount])};
  for(const f of SHARDS){said.textContent=f;await load(f)}
  hits.sort((a,b)=>a[0]-b[0]||a[1]-b[1]);said.textContent=hits.length;
  list.replaceChildren(...hits.slice(0,1000).map(([,order,text,type,amount])=>{
    const d=document.createElement('details');d.className='item';const s=document.createElement('summary');s.textContent=`${text} (${type}) × ${amount}`;d.append(s);
    d.ontoggle=()=>{if(d.open&&d.children.length<2)contexts(order,d)};return d}));
}
async function contexts(order,d){
  const o=document.createElement('ol');d.append(o);onItem=()=>{};
  onContext=(at,text)=>{if(at===order){const l=document.createElement('li');l.textContent=text;o.append(l)}};
  for(const [f,first,last] of SHARDS.map((f,n)=>[f,...BOUNDS[n]]))if(first<=order&&order<=last)await load(f);
}
document.getElementById('go').onclick=search;
"""


def search_site(items: DataFrame, contexts: DataFrame, keys: Sequence[str], folder: str, lines: int = 20_000, overwrite: bool = False) -> str:
    """index.html and shards of lines lines at most: a page that searches any number of items, however common.

    items: (original_order, type_ru, text, amount); contexts: stats.item_contexts(). An
    item is a line, and so is each of its contexts, so a common item goes over as many
    shards as it needs. The page reads one shard at a time; the driver learns of the
    shards' names and bounds only. Contexts that are given twice are lines once.
    """
    spark = items.sparkSession
    target = _guard(spark, f"{folder}/index.html", overwrite)

    def called(name: str, *values) -> F.Column:
        return F.concat(F.lit(f"{name}("), F.array_join(F.array(*values), ","), F.lit(");"))

    def quoted(c: str) -> F.Column:
        return F.regexp_replace(F.to_json(F.struct(F.col(c).alias("x"))), r'^\{"x":|\}$', "")

    order = F.col("original_order").cast("string")
    none = [F.lit(None).cast(contexts.schema[k].dataType).alias(k) for k in (*keys, "sent_no")]
    heads = items.select("original_order", F.lit(0).alias("part"), *none, called("i", order, quoted("text"), quoted("type_ru"), F.col("amount").cast("string")).alias("value"))
    placed = contexts.join(items.select("original_order", "type_ru", "text"), ["type_ru", "text"])
    rest = placed.select("original_order", F.lit(1).alias("part"), *keys, "sent_no", called("c", order, quoted("sentence")).alias("value"))
    by = ["original_order", "part", *keys, "sent_no"]
    # sentences are moved once for their item's order and once for the ranges, which tasks write as they are
    rows = heads.unionByName(rest).repartitionByRange(*by).groupBy(*by, "value").agg(F.lit(0)).sortWithinPartitions(*by, "value")
    path = f"{folder}/shards"
    rows.select("value").write.mode("overwrite" if overwrite else "errorifexists").option("maxRecordsPerFile", lines).text(path)
    said = F.regexp_extract("value", r"^.\(([0-9]+)", 1).cast("long")
    written = spark.read.text(path).groupBy(F.input_file_name().alias("file")).agg(F.min(said).alias("a"), F.max(said).alias("b")).collect()  # a row a shard
    bounds = sorted(written, key=lambda r: [int(n) for n in re.search(r"/part-(\d+)-.*-c(\d+)", r["file"]).groups()])
    names = ["shards/" + r["file"].rsplit("/", 1)[1] for r in bounds]
    kinds = "".join(f"<option>{html.escape(r['type_ru'])}</option>" for r in items.select("type_ru").distinct().orderBy("type_ru").collect())
    body = f'<input id="needle"><select id="kind"><option value=""></option>{kinds}</select><button id="go">Найти</button> <span id="said"></span><div id="results"></div>'
    script = f"const SHARDS={json.dumps(names)},BOUNDS={json.dumps([[r['a'], r['b']] for r in bounds])};{_SITE}"
    put_text(spark, target, _PAGE.format(title="Члены предложений", body=body, script=script), overwrite)
    return target


def statistics_page(sents: DataFrame, ents: DataFrame, folder: str, overwrite: bool = False) -> str:
    """statistics.html: totals, the top member and the share of each category, as cards and bars."""
    target = _guard(sents.sparkSession, f"{folder}/statistics.html", overwrite)
    words = stored(S.word_counts(ents), "statistics-words")  # phrases are made once for all numbers
    total = S.global_stats(sents, ents.limit(0)).first().asDict() | words.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("members_total")).first().asDict()
    tops = {r["type_ru"]: r for r in S.top_of(words).collect()}
    parts = S.shares(S.totals_of(words)).orderBy("cat_no").collect()
    named = (("Предложений", "sentences_total"), ("Слов", "words_total"), ("Членов предложения", "members_total"))
    body = "".join(f'<div class="card"><b>{total[k]}</b> {n}</div>' for n, k in named)
    for r in parts:
        top = tops[r["type_ru"]]
        body += f'<div class="card">{html.escape(r["type_ru"])}: {r["n"]} ({r["percent"]} %), {html.escape(top["top_word"])} ({top["top_count"]})<div style="background:#69c;height:.5rem;width:{r["percent"]}%"></div></div>'
    put_text(sents.sparkSession, target, _PAGE.format(title="Статистика", body=body, script=""), overwrite)
    return target


def analysis(items: DataFrame, sents: DataFrame, ents: DataFrame, folder: str, overwrite: bool = False) -> list[str]:
    """Both pages; neither is written if one is there already and must stay."""
    for name in ("list.html", "statistics.html"):
        _guard(items.sparkSession, f"{folder}/{name}", overwrite)
    return [search_page(items, folder, overwrite), statistics_page(sents, ents, folder, overwrite)]


def evaluation(classes: DataFrame, cells: DataFrame, path: str, model_name: str = "", overwrite: bool = True) -> None:
    """evaluation_results.json: when, classes, macro means, weighted means, the mean f1 of the sentence's members and the confusion matrix; a few rows each."""
    from ..operators import metrics as M

    now = datetime.now()
    kept = ("precision", "recall", "f1", "support")
    rows = classes.collect()
    members = [r["f1"] for r in rows if r["class"] != "O"]
    found = {
        "evaluation_info": {"timestamp": now.isoformat(), "date": f"{now:%Y-%m-%d}", "time": f"{now:%H:%M:%S}", "model_name": model_name},
        "per_class": {r["class"]: {k: r[k] for k in kept} for r in rows},
        "weighted": M.weighted(classes).first().asDict(),
        "macro": M.macro(classes).first().asDict(),
        "members_f1": sum(members) / len(members) if members else None,
        "confusion": [r.asDict() for r in cells.collect()],
        "report": M.report(classes, sum(r["support"] for r in rows)),
    }
    put_text(classes.sparkSession, path, json.dumps(found, ensure_ascii=False, indent=2, default=float), overwrite)


def metadata(spark: SparkSession, path: str, model_name: str, max_len: int = 128, overwrite: bool = False) -> None:
    """metadata.json of a model: its labels, ids, special tokens and the names of the sentence's members."""
    found = {
        "model_type": "bert_ner",
        "model_name": model_name,
        "num_labels": len(schema.LABELS),
        "max_len": max_len,
        "labels": [x[1] for x in schema.LABELS],
        "id2label": {str(x[0]): x[1] for x in schema.LABELS},
        "label2id": {x[1]: x[0] for x in schema.LABELS},
        "pad_token_id": schema.PAD,
        "special_tokens": {"pad": "[PAD]", "unk": "[UNK]", "cls": "[CLS]", "sep": "[SEP]", "mask": "[MASK]"},
        "sentence_parts": {x[2]: x[3] for x in schema.LABELS if x[2] != "O"},
    }
    put_text(spark, path, json.dumps(found, ensure_ascii=False, indent=2), overwrite)


def label_config(labels: DataFrame, path: str, overwrite: bool = False) -> None:
    """A configuration's id2label, of labels (label_id, label): a few rows by nature."""
    found = {str(r["label_id"]): r["label"] for r in labels.orderBy("label_id").collect()}
    put_text(labels.sparkSession, path, json.dumps({"id2label": found}, ensure_ascii=False), overwrite)


def listing(sents: DataFrame, ents: DataFrame, keys: Sequence[str], none: str = "-") -> DataFrame:
    """(keys, sent_no, line): the entities of each sentence by type, as the console shows them; none for a sentence without any."""
    by = [*keys, "sent_no"]
    pair = F.struct("type_ru", "texts")
    said = S.by_type(ents, keys).groupBy(*by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(pair)), lambda x: F.concat(x["type_ru"], F.lit(": "), x["texts"])), "; ").alias("line"))
    return sents.select(*by).join(said, by, "left").withColumn("line", F.coalesce("line", F.lit(none)))
