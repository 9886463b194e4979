"""Fixed schemas of the stored tables (field names follow the English operator vocabulary)."""

from __future__ import annotations

MATCH = (
    "struct<match_id:bigint,kickoff:timestamp,home:string,away:string,home_id:string,away_id:string,"
    "score_home:int,score_away:int,status:string,p1:double,px:double,p2:double,observed_at:timestamp,"
    "missing_in_frame:boolean>"
)
PAYOUT = "struct<rank:int,winners:bigint,amount:double>"

POOL = (
    "pool_id bigint, pool_type int, global_id bigint, title string, status string, closed_at timestamp, "
    "collected_at timestamp, net_stakes double, distributed double, guaranteed double, added double, "
    f"result_code string, payouts array<{PAYOUT}>, histogram array<bigint>, matches array<{MATCH}>"
)

# The stored field names of the page form.
PAGE_POOL = (
    "grille_id bigint, grille_type string, url string, scraped_at string, statut string, "
    "matches array<struct<home:string,away:string,score_home:bigint,score_away:bigint,resultat:string,"
    "tous_gagnants:boolean,annulation_deduite_de:string>>, "
    "rapports array<struct<rang:string,nombre_gagnants:bigint,montant:double>>, montant_distribue double, "
    "mention_annulation string, annulation_indice string, "
    "lignes_ignorees array<struct<ligne:int,motif:string,texte:string>>"
)

# The stored field names of the archive form.
ARCHIVE_POOL = (
    "produit string, numero int, date string, "
    "matchs array<struct<home:string,away:string,issue:string,cotes:array<double>,score:array<int>,"
    "debut:string>>, rapports array<struct<bons:int,gagnants:bigint,rapport:double>>, reglee boolean, "
    "repartition string, cotees int, url string, precedente string"
)

PRICES = "struct<p1:double,px:double,p2:double>"

FIXTURE = (
    "home_name string, away_name string, home_key string, away_key string, match_date date, "
    f"goals_home int, goals_away int, prices map<string,{PRICES}>, competition string"
)

MATCH_PRICE = ("match_id bigint, p1 double, px double, p2 double, source string, division string, "
               "pool_type int, pool_id bigint")
POOL_DATE = ("pool_type int, pool_id bigint, date date, date_min date, date_max date, source string, "
             "concordant int, uncertainty int")
ALIAS = ("folded string, target string, display string, confirmations bigint, appearances bigint, via string")
CATEGORY = ("pool_type int, pool_id bigint, category string, family string, families map<string,bigint>, "
            "competitions map<string,bigint>, n bigint, named bigint")

SNAPSHOT = ("pool_type int, pool_id bigint, match_id bigint, collected_at timestamp, p1 double, px double, p2 double, "
            "observed_at timestamp")
