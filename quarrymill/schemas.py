"""Explicit schemas of the relations; nothing is inferred on a query path."""

EVENT = "t string, job string, svg_sha string, event string, pos int, ranker string"
FINDING = "candidate_id string, layer string, rule string, severity string, detail string"
BUCKET = "bucket string, shown long, chosen long, rejected long, successes long, attempts long, last_t string, veto boolean"
MODEL = "feature string, ord int, weight double, mean double, scale double"
REQUIREMENT = "id string, requirement string, source string, category string, check_type string, check_value string"
CANDIDATE = (
    "id string, file string, prompt_family string, prompt string, preset string, filter_speckle int, hierarchical string, use_palette boolean,"
    " hard int, advisory int, layer_a_hard int, layer_b_hard int, node_count_max int, declared_colors int, rendered_colors int,"
    " fidelity_verdict string, fidelity_measured boolean, mae_art double, speckle_count int, glow_area_pct double, luma_delta double, silhouette_iou double, triage map<string,double>"
)
PIXELS = "image_id string, y int, x int, r int, g int, b int"
ELEMENTS = "doc_id string, node_id long, parent_id long, ord int, depth int, tag string, attrs map<string,string>"
