"""Texts that results must carry word for word."""

# Messages of the constraint step.
UNKNOWN_TYPE = "不支持的内容类型: "
MISSING_ELEMENT = "缺少必需元素: "
FEW_STEPS = "steps数量不足: 需要至少%d个，实际%d个"
EMPTY_CONCEPT = "Concept必须包含introduction或sections"
MISSING_FIELD = "缺少必需字段"
STEP_FORMAT = "第%d个step格式错误: 必须是字典"
STEP_CMD = "第%d个step缺少必需字段: cmd"
SECTION_ID = "ID重复: "
EMPTY_REFERENCE = "Reference必须包含properties、table或sections中的至少一项"
TABLE_FORMAT = "table必须是字典格式"
TABLE_FIELDS = "table必须包含columns和rows字段"

# Suggestions for constraint messages.
SUGGEST_ELEMENT = "添加缺失的元素到结构化数据中"
SUGGEST_STEP = "至少添加一个步骤到steps数组"
SUGGEST_CONCEPT = "添加introduction字段或至少一个section"
SUGGEST_OTHER = "检查并修复: "

# Advice of the quality report, in the order in which it is given.
ADVICE_MISSING = "文档缺少某些必需元素，请确保所有DITA必需元素都已包含"
ADVICE_ORDER = "元素顺序不符合DITA规范，请调整元素的排列顺序"
ADVICE_ID = "某些ID格式不正确，ID应以字母开头，仅包含字母、数字、-_."
ADVICE_TITLE = "标题长度需要调整："
ADVICE_STEPS = "步骤数量较多，考虑拆分为多个子任务以提高可读性"
ADVICE_DEPTH = "文档嵌套层次过深，建议简化结构或拆分主题"
ADVICE_LOOP = "文档需要多次修复才能通过验证，建议在初始生成时加强质量控制"
ADVICE_NONE = "文档质量良好，继续保持当前的编写标准"
TITLE_LONG = "考虑缩短标题或使用shortdesc补充说明"
TITLE_SHORT = "提供更具描述性的标题"

# The title of a merged document.
MERGED_TITLE = "合并后的完整文档"

# Messages and suggestions of issues, by check and kind. {root}, {element}, {id}, {step} and {count} are filled in.
ISSUE_MESSAGES = {
    "l3": {
        "MissingDeclaration": "缺少XML声明",
        "MissingEncoding": "XML声明缺少encoding属性",
        "MissingDoctype": "缺少DOCTYPE声明",
        "EmptyElement": "元素 <{element}> 为空",
        "DuplicateID": 'ID "{id}" 重复出现 {count} 次',
        "InvalidIDFormat": 'ID "{id}" 格式不符合规范',
        "MissingRequiredElement": "<{root}> 缺少必需的 <{element}> 元素",
        "MissingSteps": "<taskbody> 缺少必需的 <steps> 元素",
        "MissingCommand": "第 {step} 个 <step> 缺少必需的 <cmd> 元素",
        "EmptySteps": "<steps> 必须至少包含一个 <step>",
    },
    "l4": {
        "EmptyElement": "元素 <{element}> 为空",
        "DuplicateID": 'ID "{id}" 重复使用',
        "InvalidIDFormat": 'ID "{id}" 格式无效（必须以字母开头，只能包含字母、数字、-_. ）',
        "MissingRequiredElement": "<{root}> 必须包含 <{element}> 元素",
        "MissingSteps": "<taskbody> 必须包含 <steps> 元素",
        "MissingCommand": "第 {step} 个 <step> 缺少必需的 <cmd> 元素",
        "EmptySteps": "<steps> 必须至少包含一个 <step>",
        "InvalidRootElement": "根元素必须是task/concept/reference之一，实际为: {element}",
        "ElementOrderError": "元素 <{element}> 的顺序不正确",
    },
}
ISSUE_SUGGESTIONS = {
    "MissingDeclaration": '添加: <?xml version="1.0" encoding="UTF-8"?>',
    "MissingEncoding": '添加: encoding="UTF-8"',
    "MissingDoctype": "DITA文档应包含DOCTYPE声明",
    "InvalidIDFormat": "ID必须以字母开头，只能包含字母、数字、下划线、连字符、点号",
}
