"""Record types."""

MESSAGE = "struct<role:string,content:string>"
RICH_MESSAGE = "struct<role:string,content:string,tool_calls:string,reasoning_content:string>"
CONVERSATION = f"array<{MESSAGE}>"
RICH_CONVERSATION = f"array<{RICH_MESSAGE}>"
CANONICAL = f"id string, conversations {CONVERSATION}"
FROM_VALUE = "array<struct<from:string,value:string>>"
TOOL_CALL = "struct<id:string,type:string,function:struct<name:string,arguments:string>>"
FEATURE = (
    "id string, input_ids array<int>, loss_mask array<int>, "
    "hidden_state array<float>, aux_hidden_state array<float>"
)
RESULT_METRIC = "struct<Name:string,output_throughput:double,accept_length:double>"
RESULT_ROW = (
    "struct<batch_size:int,steps:int,topk:int,num_draft_tokens:int,"
    f"metrics:array<{RESULT_METRIC}>>"
)
RESULT_DOCUMENT = (
    f"map<string,map<string,struct<benchmark_name:string,results:array<{RESULT_ROW}>>>>"
)
METRIC_LOG = "run string, step bigint, mode string, position int, metric string, value double"
