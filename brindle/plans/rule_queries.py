"""Queries over text, trade, instruction, layout and validation rules, and the same results in DuckDB SQL. The values that
the rules work on are made from the tables, in the spellings that the rules are about."""

from __future__ import annotations

from pyspark.sql import functions as F

from brindle.functions import nested, trade
from brindle.functions import text as tx
from brindle.operators import corpus, evaluate, evidence, layout, similarity, validate
from brindle.plans import documents
from brindle.plans.file_queries import choose, pick
from brindle.plans.queries import query, table
from brindle.plans.schemas import GOODS, INSTRUCTION


def quoted(*values: str | None) -> list[str]:
    """SQL texts."""
    return ["NULL" if v is None else "'" + v.replace("'", "''") + "'" for v in values]


def cases(by: str, *values: str | None) -> str:
    return pick(by, *quoted(*values))


# -- text rules ---------------------------------------------------------------------------------------------


@query(
    f"""SELECT c_custkey AS id, 'https://www.google.com/search?q=' || replace(c_name, '#', '%23') || '+x' AS url, lower(c_name) || ' x' AS line, {cases('c_custkey', 'Sü', 'Sü', 'plain é', 'é')} AS repaired,
    'ERP-20240305-' || lpad(CAST(c_custkey % 24 AS VARCHAR), 2, '0') || '070' AS tracking, {cases('c_custkey', 'Duz OCR', 'Florence-2 VLM', 'new')} AS layout, 'u' || c_custkey || chr(10) || chr(10) || '--- ORTA BOLGE ---' || chr(10) || chr(10) || 'm' || chr(10) || chr(10) || '--- ALT BOLGE ---' || chr(10) || chr(10) AS regions,
    left(c_name, 2) || '***' || right(c_name, 1) AS masked, '+9***0' AS phone, 300 AS n_title, 40 AS n_excerpt FROM customer"""
)
def text_rules(spark, sf_dir):
    """P13, P15, P20, P23, P24, P27, P59, P60."""
    rows = table(spark, sf_dir, "customer")
    broken = choose(F.col("c_custkey"), "SÃ¼", "Sü", "plain é", "é")
    moment = F.make_timestamp(F.lit(2024), F.lit(3), F.lit(5), (F.col("c_custkey") % 24).cast("int"), F.lit(7), F.lit(9))
    person = tx.mask_fields(F.struct(F.col("c_name").alias("name"), F.struct(F.lit("+901112220").alias("phone")).alias("contact")), ["name", "contact.phone"])
    payload = tx.relevance_payload(F.repeat("c_name", F.lit(50)), F.lit("s"), F.lit("u"), F.repeat("c_name", F.lit(50)), 40)
    return rows.select(
        F.col("c_custkey").alias("id"), tx.query_url(F.concat("c_name", F.lit(" x"))).alias("url"), tx.boilerplate_key(F.concat(F.lit("  "), "c_name", F.lit("\t X "))).alias("line"), tx.repair_utf8(broken).alias("repaired"), tx.tracking_number(moment).alias("tracking"),
        tx.layout_label(choose(F.col("c_custkey"), "off", "hybrid", "new")).alias("layout"), tx.join_regions(F.concat(F.lit("u"), F.col("c_custkey").cast("string")), F.lit("m"), F.lit(None).cast("string")).alias("regions"), person["name"].alias("masked"), person["contact"]["phone"].alias("phone"),
        F.length(payload["source"]["title"]).alias("n_title"), F.length(payload["limited_text_excerpt"]).alias("n_excerpt"),
    )


# -- trade rules --------------------------------------------------------------------------------------------


@query(
    f"""SELECT p_partkey AS id, {cases('p_partkey', 'BK-77', 'BK78', None, 'BK79')} AS booking, {cases('p_partkey', 'CSQU3054383,MSKU6011672', 'CSQU3054383', '')} AS containers, {pick('p_partkey', 'true', 'false', 'false', 'true')} AS iso_date,
    {pick('p_partkey', '1234.5', '1.5', '12.0', 'NULL', '1500.0')}::DOUBLE AS volume, {cases('p_partkey', 'LBR', 'KGM', 'TON', 'KGM')} AS unit, {cases('p_partkey', '1234567890', None, None)} AS tax, {cases('p_partkey', '45G1', '22R1', 'ZZZZ', '4')} AS code,
    {cases('p_partkey', 'tea', '10 pallets', 'boxwood', 'rice')} AS goods, {cases('p_partkey', 'UN 1993', 'UN 1203', 'X1')} AS un, {cases('p_partkey', 'Class 3', 'Class 2.1', 'none')} AS imdg, {cases('p_partkey', 'PG II', 'PG III', 'PG I', 'x')} AS packing,
    {cases('p_partkey', 'REEFER SETTINGS: TEMP:-18.0CEL', 'REEFER SETTINGS: TEMP:5.5FAH, TEMP:2.0CEL', None)} AS reefer, {cases('p_partkey', None, 'Ann', None)} AS name, {cases('p_partkey', '0512', 'p', '+90 (5)')} AS phone, {pick('p_partkey', 'true', 'false')} AS safe, {pick('p_partkey', 'true', 'true', 'false')} AS language,
    {cases('p_partkey', 'BOOKING of the vessel', 'ab xyzzy', 'DATE DATE')} AS words FROM part"""
)
def trade_rules(spark, sf_dir):
    """P16, P17, P25, P31, P33, P35, P36, P37, P39, P41, P43, P44, F14, F15."""
    booking = choose(F.col("p_partkey"), "x\nBOOKING NO: BK-77\n", "carrier booking reference: BK78.", "booked", " bkg # BK79 ")
    text = choose(F.col("p_partkey"), "MSKU1234567 CSQU3054383, MSKU6011672 CSQU3054383", "CSQU3054383", "XCSQU3054383")
    weight = choose(F.col("p_partkey"), "W 500 lbs net", "500", "about 500 tons", "kg 1")
    reefer = choose(F.col("p_partkey"), "SET POINT TEMP: -18 C", "TEMP 5.5 F and temperature: 2 celsius", "warm")
    phone = trade.phone_from_name(choose(F.col("p_partkey"), "TEL: 0512", "Ann", "+90 (5)"), choose(F.col("p_partkey"), "", "p", F.lit(None).cast("string")))
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("id"), tx.labelled_value(booking, trade.LABELS["booking"]).alias("booking"), F.array_join(trade.container_references(text), ",").alias("containers"), trade.valid_iso_date(choose(F.col("p_partkey"), "2024-02-29", "2023-02-29", "29.02.2024", "2024-01-01T10:00:00Z")).alias("iso_date"),
        trade.parse_volume(choose(F.col("p_partkey"), "1,234.5", "1,5", "12", "x", "1.500,00")).alias("volume"), trade.weight_unit(weight, F.lit("500")).alias("unit"), trade.tax_number(choose(F.col("p_partkey"), "123 456-7890", "0000000000", "12")).alias("tax"),
        trade.nearest_code(choose(F.col("p_partkey"), "45G2", "22r1", "ZZZZ", "4"), ["45G1", "22R1"]).alias("code"), trade.goods_description(choose(F.col("p_partkey"), "10 pallets tea", "10 pallets", "boxwood", "CARTONS rice")).alias("goods"), trade.dangerous_goods(choose(F.col("p_partkey"), "un1993", " 1203", "X1"), "un").alias("un"),
        trade.dangerous_goods(choose(F.col("p_partkey"), "3", "class 2.1", "none"), "class").alias("imdg"), trade.dangerous_goods(choose(F.col("p_partkey"), "pg2", "III", "1", "x"), "group").alias("packing"), trade.reefer_remarks(reefer).alias("reefer"), phone[0].alias("name"), phone[1].alias("phone"),
        trade.valid_identifier(choose(F.col("p_partkey"), "a_b-1", "a b")).alias("safe"), validate.valid_language(choose(F.col("p_partkey"), "tr", "auto", "de")).alias("language"), trade.correct_words(choose(F.col("p_partkey"), "BOKING of the vessel", "ab xyzzy", "DATE DTE"), ["BOOKING", "DATE", "VESSEL", "THE"]).alias("words"),
    )


@query(
    f"""SELECT s_suppkey AS id, {cases('s_suppkey', '5 Main St', 'Quay 7', None, 'Ataturk 12', '--x', None)} AS street, {cases('s_suppkey', 'Oslo', 'IZMIR', None, 'Istanbul', None, None)} AS city, {cases('s_suppkey', 'DE', 'TR', 'TR', 'tr', 'DE', None)} AS country FROM supplier"""
)
def address_rules(spark, sf_dir):
    """Streets that hold a country and a city."""
    k = F.col("s_suppkey")
    street = choose(k, "5 Main St, Germany", "Quay 7 - IZMIR / turkey", "TURKEY", "Ataturk 12, Istanbul", "--x", "--")
    city = choose(k, "Oslo", F.lit(None).cast("string"), F.lit(None).cast("string"), "-", "Germany", F.lit(None).cast("string"))
    country = choose(k, F.lit(None).cast("string"), "?", F.lit(None).cast("string"), "tr", F.lit(None).cast("string"), "/")
    a = F.struct(street.alias("street"), city.alias("city"), F.lit(None).cast("string").alias("postal_code"), country.alias("country_code"))
    rows = table(spark, sf_dir, "supplier").select(k.alias("id"), a.alias("a"))
    fixed = rows.select("id", trade.address(F.col("a"), {"TURKEY": "TR", "GERMANY": "DE"}, ["IZMIR", "ISTANBUL"]).alias("x"))
    return fixed.select("id", F.regexp_replace("x.street", "^x$", "--x").alias("street"), "x.city", F.col("x.country_code").alias("country"))


@query(
    f"""SELECT p_partkey AS id, {cases('p_partkey', '45G1,22G1', '22R1,45G1', 'NONE,42U1', '45R1')} AS codes, {cases('p_partkey', '45G1@1,22G1@21', '45G1@1,22R1@8', '42U1@5', '45R1@3')} AS mentions FROM part"""
)
def nearest_types(spark, sf_dir):
    """Each container takes the nearest type that none before it took."""
    text = choose(F.col("p_partkey"), "40HC CSQU3054383 xx 20' DRY VAN MSKU6011672", "40HQ   20 reefer", "120 40OT", "a 45' HC REEFER")
    mentions = trade.equipment_mentions(text)
    none = F.lit(None).cast("int")
    wanted = choose(F.col("p_partkey"), F.array(F.lit(6), F.lit(30)), F.array(F.lit(9), none), F.array(F.lit(-1), none), F.array(none))
    got = trade.assign_nearest(wanted, mentions)
    spelled = F.array_join(F.transform(mentions, lambda m: F.concat(m["code"], F.lit("@"), m["at"].cast("string"))), ",")
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.array_join(F.transform(got, lambda c: F.coalesce(c, F.lit("NONE"))), ",").alias("codes"), spelled.alias("mentions"))


# -- instructions -------------------------------------------------------------------------------------------


def _instructions(spark, sf_dir):
    """Orders as instructions and texts in which every rule finds something to do. The rules take long for a row, so the
    narrow rows are dealt to all cores, in parts small enough to end together, before they become instructions."""
    orders = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    parts = max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    orders = orders.select("o_orderkey", "o_orderdate", "c_name").repartition(parts, "o_orderkey")
    k = F.col("o_orderkey")
    key = k.cast("string")
    party = F.struct(
        choose(k, "shipper", "EXPORTER", "CZ").alias("party_role_code"), choose(k, "VKN: 123-456-7890", F.col("c_name"), "TAX ID X9").alias("party_id"), F.col("c_name").alias("party_name"),
        F.struct(F.lit("Kordon 5, IZMIR / TURKEY").alias("street"), F.lit("-").alias("city")).alias("address"), F.struct(choose(k, "TEL: 0512345", "Ann").alias("name")).alias("contact_details"),
    )
    text_null, number_null = F.lit(None).cast("string"), F.lit(None).cast("double")
    container = lambda ref, code, weight: F.struct(F.lit(ref).alias("equipment_reference"), code.alias("iso_equipment_code"), F.struct(weight.alias("weight"), F.lit("KGM").alias("unit")).alias("cargo_gross_weight"))
    containers = F.array(container("MSKU6011672", text_null, choose(k, number_null, F.lit(1850000.0))), container("CSQU3054383", choose(k, text_null, "45G2"), number_null))
    goods = F.array(F.struct(F.lit("un1993").alias("un_number"), F.lit("3").alias("imdg_class"), F.lit("pg2").alias("packing_group")))
    item = lambda n, kind, description, dangerous, weight: F.struct(F.lit(n).alias("package_quantity"), F.lit(kind).alias("package_kind_code"), F.lit(description).alias("description_of_goods"), dangerous.alias("dangerous_goods_list"), F.struct(weight.alias("weight_value")).alias("weight"))
    cargo = F.array(item(10, "cartons", "10 cartons tea", goods, F.lit(70000.0)), item(5, "PLX", "salt", F.when(F.lit(False), goods), number_null))
    refs = F.array(F.struct(F.lit("BL").alias("type_code"), F.concat(F.lit("A  "), key).alias("reference_number")), F.struct(F.lit("bl").alias("type_code"), F.concat(F.lit("a "), key).alias("reference_number")))
    plan = F.struct(F.lit(1).alias("leg_sequence_number"), F.struct(F.lit("TRIZM IZMIR").alias("location_name")).alias("port_of_loading"), F.struct(F.lit("HAMBURG").alias("location_name")).alias("port_of_discharge"))
    body = F.struct(
        F.array(party).alias("parties"), containers.alias("equipment_list"), cargo.alias("cargo_items"), refs.alias("document_references"), F.array(plan).alias("transport_plans"), F.struct(choose(k, "Alsancak", "Izmir").alias("location_name")).alias("place_of_issue"),
        choose(k, F.lit(None).cast("string"), "handle").alias("remarks"), choose(k, F.lit(None).cast("string"), F.lit(None).cast("string"), "PPX").alias("freight_payment_term_code"),
    )
    text = F.concat_ws(
        "\n", F.concat(F.lit("SHIPPING INSTRUCTION NO: SI-"), key), F.concat(F.lit("BOOKING NO: BK"), key), F.concat(F.lit("DATE: "), F.date_format("o_orderdate", "dd.MM.yyyy")), F.lit("VERGI DAIRESI: ALSANCAK"), F.lit("SALT CSQU3054383 40HC"), F.lit("TEA MSKU6011672 20' DRY VAN"),
        F.lit("GROSS WEIGHT: 18.750,50 KG"), F.lit("NET WEIGHT 17,000 LBS"), F.lit("VOLUME: 28,16 /"), F.lit("and 12.5 CBM /"), F.lit("SET POINT TEMP: -18 C"), F.lit("TCLU4265789"), choose(k, "FREIGHT PREPAID", "FREIGHT COLLECT"), choose(k, "SEA WAYBILL", "B / L"),
    )
    return orders.select(k.alias("doc_id"), "c_name", "o_orderdate", F.from_json(F.to_json(body), INSTRUCTION).alias("instruction"), text.alias("text"))


@query(
    f"""SELECT o_orderkey AS doc_id, 'DRF' AS status, 'SI-' || o_orderkey AS reference, 'BK' || o_orderkey AS booking, strftime(o_orderdate, '%Y-%m-%d') AS issued, CASE WHEN o_orderkey % 2 = 1 THEN 'Izmir' END AS place, 'CZ' AS role, {pick('o_orderkey', "'1234567890'", 'NULL', "'X9'")} AS party_id,
    'Kordon 5' AS street, 'IZMIR' AS city, 'TR' AS country, {cases('o_orderkey', None, 'Ann')} AS contact, {cases('o_orderkey', '0512345', None)} AS phone, 'IZMIR' AS loading, 'CSQU3054383,MSKU6011672,TCLU4265789' AS containers, {cases('o_orderkey', '45G1,22G1,NONE', '45G1,45G1,22G1')} AS types,
    {cases('o_orderkey', '18750.5@1', '18500.0@1')} AS gross, 'salt,tea' AS goods, {cases('o_orderkey', 'PL,CT')} AS packages, '17000.0 LBR,700.0 ' AS weights, '28.16,12.5' AS volumes, 'UN 1993/Class 3/PG II' AS dangerous, 1 AS n_refs, {cases('o_orderkey', 'REEFER SETTINGS: TEMP:-18.0CEL', 'handle | REEFER SETTINGS: TEMP:-18.0CEL')} AS remarks,
    {cases('o_orderkey', 'SWB', 'B/L')} AS kind, CASE WHEN o_orderkey % 3 = 2 THEN 'PPD' WHEN o_orderkey % 2 = 0 THEN 'PPD' ELSE 'COL' END AS freight FROM orders"""
)
def instruction_rules(spark, sf_dir):
    """N13 to N19 and the rules that N18 calls, over whole instructions."""
    done = nested.normalize(_instructions(spark, sf_dir), countries={"TURKEY": "TR"}, cities=["IZMIR"])
    i = F.col("instruction")
    p, e, c = F.get(i["parties"], F.lit(0)), i["equipment_list"], i["cargo_items"]
    listed = lambda a, f: F.array_join(F.transform(a, f), ",")
    weights = F.filter(F.transform(e, lambda x, n: F.concat(x["cargo_gross_weight"]["weight"].cast("string"), F.lit("@"), n.cast("string"))), lambda x: x.isNotNull())
    d = F.get(F.get(c, F.lit(1))["dangerous_goods_list"], F.lit(0))
    return done.select(
        "doc_id", i["document_status_code"].alias("status"), i["shipping_instruction_reference"].alias("reference"), i["carrier_booking_reference"].alias("booking"), i["issue_date"].alias("issued"), i["place_of_issue"]["location_name"].alias("place"),
        p["party_role_code"].alias("role"), p["party_id"].alias("party_id"), p["address"]["street"].alias("street"), p["address"]["city"].alias("city"), p["address"]["country_code"].alias("country"), p["contact_details"]["name"].alias("contact"), p["contact_details"]["phone_number"].alias("phone"),
        F.get(i["transport_plans"], F.lit(0))["port_of_loading"]["location_name"].alias("loading"), listed(e, lambda x: x["equipment_reference"]).alias("containers"), listed(e, lambda x: F.coalesce(x["iso_equipment_code"], F.lit("NONE"))).alias("types"), F.element_at(weights, -1).alias("gross"),
        listed(c, lambda x: x["description_of_goods"]).alias("goods"), listed(c, lambda x: x["package_kind_code"]).alias("packages"), listed(c, lambda x: F.concat_ws(" ", x["weight"]["weight_value"].cast("string"), F.coalesce(x["weight"]["unit"], F.lit("")))).alias("weights"), listed(c, lambda x: x["volume"]["volume_value"].cast("string")).alias("volumes"),
        F.concat_ws("/", d["un_number"], d["imdg_class"], d["packing_group"]).alias("dangerous"), F.size(i["document_references"]).alias("n_refs"), i["remarks"].alias("remarks"), i["transport_document_type"].alias("kind"), i["freight_payment_term_code"].alias("freight"),
    )


@query(
    """SELECT o_orderkey AS doc_id, 'remarks,cargo_items[0].description_of_goods,cargo_items[1].description_of_goods' AS paths, 3 AS n_stage1, 'equipment_list,cargo_items' AS stage3, 'UN 3082/Class 9/PG III' AS found, '200 CT' AS unpacked, 'parties[0].party_role_code is required|cargo_items[0].weight.unit is required' AS errors
    FROM orders WHERE o_orderkey % 2 = 1 UNION ALL SELECT o_orderkey, 'cargo_items[0].description_of_goods,cargo_items[1].description_of_goods', 3, 'equipment_list,cargo_items', 'UN 3082/Class 9/PG III', '200 CT', 'parties[0].party_role_code is required|cargo_items[0].weight.unit is required' FROM orders WHERE o_orderkey % 2 = 0"""
)
def instruction_views(spark, sf_dir):
    """Parts of an instruction and what is drawn from its text."""
    rows = _instructions(spark, sf_dir)
    i = F.col("instruction")
    lacking = i.withField("parties", F.transform(i["parties"], lambda p: p.withField("party_role_code", F.lit(" "))))
    first = F.get(nested.goods_from_text(F.transform(i["cargo_items"], lambda c: c.withField("dangerous_goods_list", F.expr(f"CAST(NULL AS array<{GOODS}>)"))), F.lit("tea UN3082 class 9 packing group 3")), F.lit(1))["dangerous_goods_list"]
    g = F.get(first, F.lit(0))
    unpacked = F.get(nested.unpack(F.transform(i["cargo_items"], lambda c: c.withField("package_kind_code", trade.packaging_code(c["package_kind_code"]))), F.lit("10 drums containing 3 bags; 5 CRATES CONTAINING 9 bags")), F.lit(0))
    again = F.get(nested.unpack(F.transform(i["cargo_items"], lambda c: c.withField("package_kind_code", F.lit(None).cast("string"))), F.lit("10 PALLETS CONTAINING 200 CARTONS")), F.lit(0))
    stage1, stage3 = nested.stage_fields(i, 1), nested.stage_fields(i, 3)
    picked = F.when(unpacked["package_quantity"] == 10, F.concat_ws(" ", again["package_quantity"].cast("string"), again["package_kind_code"]))
    out = rows.select(
        "doc_id", F.array_join(F.transform(nested.translatable(i), lambda x: x["path"]), ",").alias("paths"), F.size(stage1["document_references"]).alias("n1"), F.lit(",".join(nested.STAGES[3])).alias("stage3"), F.size(stage3["cargo_items"]).alias("n3"),
        F.concat_ws("/", g["un_number"], g["imdg_class"], g["packing_group"]).alias("found"), picked.alias("unpacked"), F.array_join(validate.schema_errors(lacking), "|").alias("errors"),
    )
    return out.select("doc_id", "paths", (F.col("n1") + F.col("n3") - 1).alias("n_stage1"), "stage3", "found", "unpacked", "errors")


@query(
    """SELECT o_orderkey AS doc_id, CASE WHEN o_orderkey % 2 = 0 THEN 'long_document,ocr_alphanumeric_noise' ELSE 'transport_negative,turkish,sparse_optional_fields' END AS features, CASE WHEN o_orderkey % 2 = 0 THEN 9 ELSE 24 END AS score FROM orders"""
)
def document_difficulty(spark, sf_dir):
    """The features of hard documents and their weights."""
    k = F.col("o_orderkey")
    full = F.struct(F.lit("B/L").alias("transport_document_type"), F.lit("a").alias("shipping_instruction_reference"), F.lit("b").alias("carrier_booking_reference"), F.lit("c").alias("remarks"), F.lit("2024-01-01").alias("issue_date"))
    i = F.from_json(F.when(k % 2 == 0, F.to_json(full)).otherwise(F.lit('{"remarks": "x"}')), INSTRUCTION)
    text = F.when(k % 2 == 0, F.concat(F.lit("AB1CD2 "), F.repeat(F.lit("x"), F.lit(1800)))).otherwise(F.lit("Alıcı: me"))
    rows = table(spark, sf_dir, "orders").select(k.alias("doc_id"), i.alias("i"), text.alias("t"))
    found = corpus.difficulty_features(F.col("i"), F.col("t"), ["alici", "alıcı"])
    names, score = corpus.difficulty({n: (c, corpus.DIFFICULTY[n]) for n, c in found.items()})
    return rows.select("doc_id", F.array_join(names, ",").alias("features"), score.alias("score"))


@query(
    """SELECT o_orderkey AS doc_id, CASE WHEN o_orderkey % 2 = 0 THEN 's1' ELSE 's2' END AS status, 'p1' AS parties, 't2' AS plans, 'c3' AS cargo, 'tea|b' AS kept, '{"a":"x","c":1}' AS pruned, 'a,b' AS parsed FROM orders"""
)
def merged_stages(spark, sf_dir):
    """Stages merged, the top pruned, answers parsed from noise."""
    k = F.col("o_orderkey")
    stage = lambda n, status: F.struct(status.alias("status"), F.lit(f"p{n}").alias("parties"), F.lit(f"t{n}").alias("plans"), F.lit(f"c{n}").alias("cargo"))
    none = F.lit(None).cast("string")
    merged = nested.merge_stages({"one": stage(1, F.when(k % 2 == 0, F.lit("s1"))), "two": stage(2, F.lit("s2")), "three": stage(3, none)}, {"parties": "one", "plans": "two", "cargo": "three"}, ["status"])
    answer = nested.parse_instruction(F.concat(F.lit("Sure: {'remarks': \"tea\", \"issue_date\": \"b\",} end "), k.cast("string")))
    pruned = nested.prune_top(F.struct(F.lit("x").alias("a"), F.array().cast("array<string>").alias("b"), F.lit(1).alias("c"), none.alias("d")))
    ordered = nested.sort_keyed(F.from_json(F.lit('{"equipment_list": [{"equipment_reference": "b"}, {"equipment_reference": "a"}], "parties": [], "transport_plans": []}'), INSTRUCTION))
    rows = table(spark, sf_dir, "orders").select(k.alias("doc_id"), merged.alias("m"), answer.alias("a"), pruned.alias("p"), ordered.alias("o"))
    return rows.select("doc_id", "m.status", "m.parties", "m.plans", "m.cargo", F.concat_ws("|", "a.remarks", "a.issue_date").alias("kept"), F.col("p").alias("pruned"), F.array_join(F.transform("o.equipment_list", lambda e: e["equipment_reference"]), ",").alias("parsed"))


# -- layout and evidence ------------------------------------------------------------------------------------


@query(
    """WITH b AS (SELECT l_orderkey AS doc, l_linenumber AS position, l_partkey, l_quantity * 20 AS y, l_linenumber % 3 = 0 AS hit FROM lineitem), l AS (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY position, l_partkey) AS r FROM b WHERE y >= 650),
    c AS (SELECT *, sum(hit::INT) OVER (PARTITION BY doc ORDER BY r) AS upto, first_value(hit::INT) OVER (PARTITION BY doc ORDER BY r) AS f FROM l) SELECT doc, CAST(r AS INT) AS position, l_partkey, CAST(upto - f AS INT) AS chunk FROM c"""
)
def box_chunks(spark, sf_dir):
    """Boxes of the lower region, cut at container references."""
    from pyspark.sql import Window

    items = table(spark, sf_dir, "lineitem")
    text = F.when(F.col("l_linenumber") % 3 == 0, F.lit("no CSQU3054383 x")).otherwise(F.lit("box"))
    boxes = items.select(F.col("l_orderkey").alias("doc"), F.lit(1000).alias("height"), (F.col("l_quantity") * 20).alias("y_min"), text.alias("text"), "l_partkey", "l_linenumber").where("y_min >= 650")
    placed = boxes.withColumn("position", F.row_number().over(Window.partitionBy("doc").orderBy("l_linenumber", "l_partkey")))
    return layout.box_chunks(placed, ["doc"]).select("doc", "position", "l_partkey", "chunk")


@query(
    f"""SELECT c_custkey AS id, 'Shipper: a' || chr(10) || 'Gross 5 kg' || chr(10) || 'X9Z' AS excerpt, {cases('c_custkey', 'head|CSQU3054383 a', 'head|MSKU6011672 b')} AS chunk, 'name: x' AS line, 0.0::DOUBLE AS x_min, 30.0::DOUBLE AS x_max, 'lost' AS lost FROM customer"""
)
def layout_rules(spark, sf_dir):
    """Excerpts, chunks, matching lines, boxes of polygons, lost words."""
    text = F.lit("Shipper: a\nother\nGross 5 kg\n  X9Z \nShipper: a")
    excerpt = layout.review_excerpt(text, F.array(F.lit("parties[0].x"), F.lit("cargo.weight")), F.array(F.lit("x9z"), F.lit("a")))
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"))
    body = F.concat(F.lit("head\nCSQU3054383 a\nMSKU6011672 b"))
    chunks = layout.container_chunks(rows.withColumn("text", body), key="id").where(F.col("chunk") == F.col("id") % 2).select("id", F.replace("text", F.lit("\n"), F.lit("|")).alias("chunk"))
    box = layout.box_of(F.array(F.array(F.lit(0.0), F.lit(5.0)), F.array(F.lit(30.0), F.lit(5.0)), F.array(F.lit(30.0), F.lit(9.0)), F.array(F.lit(0.0), F.lit(9.0))))
    lines = evidence.matching_lines(rows.withColumns({"value": F.lit("x"), "text": F.lit("a\nname: x\nb")}))
    out = lines.select("id", F.array_join("fragments", "|").alias("line")).join(chunks, "id")
    lost = layout.lost_words(F.lit("kept lost KEPT"), F.array(F.lit("Kept"), F.lit("more")))
    return out.select("id", excerpt.alias("excerpt"), "chunk", "line", box["x_min"].alias("x_min"), box["x_max"].alias("x_max"), F.array_join(lost, ",").alias("lost"))


@query("SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE NOT (l_quantity * 20 >= 800 AND l_linenumber % 2 = 0)")
def bottom_lines(spark, sf_dir):
    """F16: constant lines at the bottom of pages go."""
    text = F.when(F.col("l_linenumber") % 2 == 0, F.lit("Page  FOOTER")).otherwise(F.lit("text"))
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", (F.col("l_quantity") * 20).alias("y_min"), F.lit(1000).alias("height"), text.alias("text"))
    return layout.without_bottom_lines(lines, ["page footer"]).select("l_orderkey", "l_linenumber", "l_partkey")


@query(
    f"""SELECT c_custkey AS id, {cases('c_custkey', 'strong', 'name', 'address', 'generic')} AS evidence_method, {pick('c_custkey', '1.0', '1.0', '0.5', '0.0')}::DOUBLE AS evidence_score, {cases('c_custkey', 'supported', 'supported', 'uncertain', 'unsupported')} AS evidence_status FROM customer"""
)
def routed_evidence(spark, sf_dir):
    """claims by the kind of their path."""
    path = choose(F.col("c_custkey"), "equipment_list[0].equipment_reference", "parties[1].party_name", "parties[0].address.street", "remarks")
    value = choose(F.col("c_custkey"), "CSQU 3054383", "Acme Traders", "Main Road", "nothing here")
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), path.alias("path"), value.alias("value"), F.lit("csqu3054383 ACME tradrs, main 5").alias("text"))
    return evidence.evidence(rows).select("id", "evidence_method", "evidence_score", "evidence_status")


# -- validation, evaluation, prompts ------------------------------------------------------------------------


@query(
    f"""SELECT s_suppkey AS id, {pick('s_suppkey', 'true', 'false', 'false')} AS review, {pick('s_suppkey', 'true', 'false')} AS better, {cases('s_suppkey', 'COMPLETED', 'DRAFT')} AS grade, {cases('s_suppkey', 'country,unlocode', '', 'country')} AS codes, {cases('s_suppkey', 'QUEUED', 'REJECTED', 'REJECTED')} AS status, {cases('s_suppkey', None, 'extension', 'empty')} AS reason FROM supplier"""
)
def decisions(spark, sf_dir):
    """F02, F13, F20, M03, M08, M09."""
    k = F.col("s_suppkey")
    found = validate.findings(validate.country_finding(choose(k, "tr", "TR", "T"), "a"), validate.unlocode_finding(choose(k, "TRIZ1", "TRIZM", "DEHAM"), "b"))
    few = table(spark, sf_dir, "supplier").where("s_suppkey < 50").select(k.alias("id"), choose(k, "a.PDF", "b.exe", "c.xml").alias("name"), choose(k, F.lit(5), F.lit(5), F.lit(0)).cast("long").alias("size"))
    admitted = validate.admit_batch(few)
    rest = table(spark, sf_dir, "supplier").where("s_suppkey >= 50").select(k.alias("id"), choose(k, F.lit(None).cast("string"), "extension", "empty").alias("reason"), choose(k, "QUEUED", "REJECTED", "REJECTED").alias("status"))
    rows = admitted.select("id", "status", "reason").unionByName(rest).withColumn("s_suppkey", F.col("id"))
    return rows.select(
        "id", validate.needs_review(choose(k, "risk", "off", "risk"), choose(k, F.lit(40), F.lit(90), F.lit(10)), F.lit(True)).alias("review"), validate.better(choose(k, F.lit(40), F.lit(20)), choose(k, F.lit(10), F.lit(10))).alias("better"),
        validate.grade(F.lit(True), choose(k, F.lit(0), F.lit(2))).alias("grade"), F.array_join(F.transform(found, lambda f: f["code"]), ",").alias("codes"), "status", "reason",
    )


@query("SELECT o_orderkey AS case, o_orderkey % 3 = 2 AS failed, CASE o_orderkey % 3 WHEN 0 THEN 2 WHEN 1 THEN 1 ELSE 0 END AS tp, CASE o_orderkey % 3 WHEN 1 THEN 1 ELSE 0 END AS fp, CASE o_orderkey % 3 WHEN 2 THEN 2 ELSE 0 END AS fn, CASE o_orderkey % 3 WHEN 1 THEN 1 ELSE 0 END AS mismatches, CASE o_orderkey % 3 WHEN 0 THEN 100.0 WHEN 1 THEN 50.0 ELSE 0.0 END AS accuracy FROM orders")
def case_scores(spark, sf_dir):
    """Each case's scores; an answer that is no JSON misses every field."""
    k = F.col("o_orderkey")
    expected = F.concat(F.lit('{"a": "X  y", "b": [{"c": '), k.cast("string"), F.lit("}], \"none\": null, \"list\": []}"))
    actual = F.when(k % 3 == 0, F.concat(F.lit('{"a": "x Y", "b": [{"c": '), k.cast("string"), F.lit("}], \"none\": null}"))).when(k % 3 == 1, F.lit('{"a": "x y", "b": [{"c": -1}], "extra": 5}')).otherwise(F.lit("broken"))
    rows = table(spark, sf_dir, "orders").select(k.alias("case"), expected.alias("e"), actual.alias("a"))
    return evaluate.evaluate_cases(rows, "e", "a").select("case", "failed", "tp", "fp", "fn", "mismatches", "accuracy")


@query("SELECT '<h1>Run</h1><table><tr><th>category</th><th>fields</th><th>tp</th><th>fp</th><th>fn</th><th>mismatches</th><th>accuracy</th><th>precision</th><th>recall</th><th>f1</th></tr>' || chr(10) || string_agg('<tr><td>' || s || '</td><td>' || n || '</td><td>' || n || '</td><td>0</td><td>0</td><td>0</td><td>100.0</td><td>100.0</td><td>100.0</td><td>100.0</td></tr>', chr(10) ORDER BY s) || '</table>' AS html FROM (SELECT replace(o_orderstatus, 'O', '&lt;O&gt;') AS s, count(*) AS n FROM orders GROUP BY 1)")
def score_report(spark, sf_dir):
    """A report of scores by category."""
    rows = table(spark, sf_dir, "orders").select(F.replace("o_orderstatus", F.lit("O"), F.lit("<O>")).alias("category"), F.col("o_orderkey").alias("case"), F.lit("x").alias("path"), F.lit("correct").alias("state"))
    return evaluate.report(evaluate.scores(rows, ["category"]), "category", "Run")


@query(
    f"""SELECT c_custkey AS id, {cases('c_custkey', 'Turkish', 'English')} AS language, {cases('c_custkey', 'whole text', 'part')} AS body, 'gross,weight' AS words, 7 AS risk, 1 AS n_values, 'audit_only_no_corrections' AS task FROM customer"""
)
def prompts(spark, sf_dir):
    """What models and reviewers are asked."""
    asked = documents.prompt(F.lit("whole text"), "{}", choose(F.col("c_custkey"), "tr", "xx"), F.lit("en"), choose(F.col("c_custkey"), "whole tex", "part"))
    found = validate.findings(validate.finding(F.lit(True), "cargo.weight", "weight"))
    values = F.array(F.struct(F.lit("cargo.weight").alias("path"), F.lit("gross,weight").alias("value")), F.struct(F.lit("other").alias("path"), F.lit("x").alias("value")))
    payload = documents.review_payload(F.lit(7), found, values, F.lit("gross,weight\nelse"))
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.regexp_extract(asked, r"is in (\w+)", 1).alias("language"), F.regexp_extract(asked, r"(?s)<text>\n(.*)\n</text>", 1).alias("body"), payload["limited_excerpt"].alias("words"), payload["local_risk_score"].alias("risk"), F.size(payload["critical_values"]).alias("n_values"), payload["task"].alias("task"))


@query()
def best_sequences(spark, sf_dir):
    """The closest document of each benchmark item by matching characters; difflib's ratio is tested by a plain loop."""
    return similarity.best_sequence(table(spark, sf_dir, "benchmark"), table(spark, sf_dir, "documents"), least=0.3)
