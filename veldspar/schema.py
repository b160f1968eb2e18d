"""Schemas as DDL. JSON is always read with one of these, never inferred."""

PAYLOAD_STRUCT = (
    "struct<id:string,transaction:struct<amount:double,installments:int,requested_at:string>,"
    "customer:struct<avg_amount:double,tx_count_24h:int,known_merchants:array<string>>,"
    "merchant:struct<id:string,mcc:string,avg_amount:double>,"
    "terminal:struct<is_online:boolean,card_present:boolean,km_from_home:double>,"
    "last_transaction:struct<timestamp:string,km_from_current:double>>"
)
PAYLOAD = PAYLOAD_STRUCT[len("struct<") : -1]
#: A labelled example as it is stored.
REFERENCE_JSON = "vector array<double>, label string"
REFERENCE = "ref_id long, vector array<float>, is_fraud boolean"
TEST_SET = (
    "references_checksum_sha256 string, stats struct<total:long,fraud_count:long,legit_count:long,fraud_rate:double,legit_rate:double,edge_case_count:long,edge_case_rate:double>, "
    f"entries array<struct<request:{PAYLOAD_STRUCT},expected_approved:boolean,expected_fraud_score:double>>"
)
RUN_RESULT = (
    "dtype string, p99 string, p99_ms struct<median:double,min:double,max:double>, "
    "scoring struct<breakdown:struct<false_positive_detections:long,false_negative_detections:long,true_positive_detections:long,true_negative_detections:long,http_errors:long>,"
    "failure_rate:string,p99_score:struct<value:double,cut_triggered:boolean>,detection_score:struct<value:double,cut_triggered:boolean>,final_score:double,raw:struct<p99_ms:double,failure_rate:double,final_score:double>>"
)
