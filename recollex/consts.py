"""Numbers and word lists that results depend on."""

# retrieval
SOURCE_WEIGHTS = {"user": 1.0, "agent_confirmed": 1.0, "system": 0.85, "agent": 0.85}
OTHER_SOURCE_WEIGHT = 0.7
TEMPORAL_SIGNALS = {
    "past": "上次 之前 上周 昨天 以前 过去 上回 前段时间 前一阵 last previous before yesterday earlier prior ago".split(),
    "future": "计划 接下来 下次 以后 打算 想要 将要 即将 plan next future upcoming will".split() + ["going to"],
    "recent": "最近 近期 刚刚 这几天 近来 近日 recent lately just recently".split(),
}
SEMANTIC_GATE, ENTITY_BOOST, FUSION_NORM = 0.08, 0.5, 3.5
BM25_K1, BM25_B = 1.5, 0.75
SIGMOID_BY_LENGTH = ((3, 5.0, 0.7), (6, 7.0, 0.6), (9, 9.0, 0.5), (15, 10.0, 0.5), (None, 12.0, 0.5))
NGRAM, NGRAM_DIM, NGRAM_TEXT = 3, 256, 512
CONNECTIVITY_STEP, CONNECTIVITY_CAP = 0.05, 0.3
SUMMARY_CHARS = 500

# lifecycle
DEMOTE_DAYS, ARCHIVE_DAYS, DENSITY_WINDOW, SCENE_DAYS, PRESSURE_MIN_ACTIVE, WIDENING = 14, 60, 20, 7, 15, 1.5
SCENE_MIN_COUNT, SCENE_MAX_COVERAGE, SCENE_MIN_LENGTH = 2, 0.3, 3
MERGE_JACCARD, MERGE_MIN_KEYWORDS, MERGE_GROUP = 0.25, 3, 5

# guards
BURST_LIMIT, BURST_SECONDS, BURST_LOCK_MINUTES = 30, 60, 5
FAILURE_LIMIT, FAILURE_SECONDS, FAILURE_LOCK_MINUTES = 3, 600, 30

# context
BUDGET_CHARS, MILD, AUTO, WARN, BUDGET_MIN = 2000, 0.7, 0.85, 0.7, 500
MILD_KEEP, MILD_CAP, HARD_KEEP, HARD_CAP = 0.6, 200, 0.3, 100
RING = {"access": 20, "contexts": 5, "rounds": 3, "turns": 10}

# learning
LESSON_PROMOTE, LESSON_PENDING, LESSON_OVERLAP = 3, 2, 0.3

# Relation labels
RELATION_LABELS = {
    "works_at": "works at", "uses": "uses", "lives_in": "lives in", "manages": "manages", "created": "created",
    "owns": "owns", "knows": "knows", "prefers": "prefers", "is_a": "is a", "belongs_to": "belongs to",
    "located_at": "located at", "develops": "develops", "depends_on": "depends on", "related_to": "related to",
    "cross_scene": "cross-scene tunnel",
}

# Triple patterns (pattern, relation), matched without regard to case
TRIPLE_PATTERNS = (
    (r"(\S{2,8})\s*是\s*(\S{2,12})(?:[，。、！？]|$)", "is_a"),
    (r"(\S{2,8})\s*在\s*(\S{2,20})\s*(?:工作|上班|任职)", "works_at"),
    (r"(\S{2,8})\s*(?:使用|用|用的是)\s*(\S{2,20})(?:[，。、！？]|$)", "uses"),
    (r"(\S{2,8})\s*(?:喜欢|热爱|偏爱)\s*(\S{2,20})(?:[，。、！？]|$)", "prefers"),
    (r"(\S{2,8})\s*(?:属于|隶属于|归属于)\s*(\S{2,20})(?:[，。、！？]|$)", "belongs_to"),
    (r"(\S{2,8})\s*(?:开发|创建|发明)\s*(?:了)?\s*(\S{2,20})(?:[，。、！？]|$)", "created"),
    (r"(\S{2,8})\s*(?:住在|居住于|位于)\s*(\S{2,20})(?:[，。、！？]|$)", "located_at"),
    (r"(\S{2,8})\s*(?:管理|负责|掌管)\s*(\S{2,20})(?:[，。、！？]|$)", "manages"),
    (r"(\S{2,8})\s*(?:拥有|持有)\s*(\S{2,20})(?:[，。、！？]|$)", "owns"),
    (r"(\S{2,8})\s*(?:认识|知道)\s*(\S{2,8})(?:[，。、！？]|$)", "knows"),
    (r"(\S{2,20})\s+is\s+(?:a|an)\s+(\S{2,20})", "is_a"),
    (r"(\S{2,20})\s+works?\s+(?:at|for)\s+(\S{2,30})", "works_at"),
    (r"(\S{2,20})\s+uses\s+(\S{2,30})", "uses"),
    (r"(\S{2,20})\s+(?:likes|loves|prefers)\s+(\S{2,30})", "prefers"),
    (r"(\S{2,20})\s+created\s+(\S{2,30})", "created"),
    (r"(\S{2,20})\s+(?:lives? in|is based in)\s+(\S{2,30})", "located_at"),
    (r"(\S{2,20})\s+(?:owns?|manages?)\s+(\S{2,30})", "owns"),
    (r"(\S{2,20})\s+(?:knows?)\s+(\S{2,20})", "knows"),
)
TRIPLE_SKIP = "他 她 它 我 你 这个 那个 什么 怎么 the a an this that it he she".split()

# Keyword stop words
KEYWORD_STOP = "the and for not are was but have this that with from been than they what when where which their will would could should about into over after still more your also very just said done made each".split()
SCENE_STOP = (
    "should may might shall this that these those it its we our you your they them their he him his she her not no but if all "
    "just very too so also now then here there about into over after before between through the and for are was were with from"
).split()

# Sentiment words
POSITIVE = "喜欢 推荐 赞成 支持 同意 选择 好 不错 可以 没问题 顺利 完成 乐观 有信心 看好 进步 成功 like love recommend support agree great good done progress success".split()
NEGATIVE = "讨厌 不喜欢 反对 拒绝 放弃 不行 不好 有问题 不看好 有风险 担心 太累 太冷清 不想 不要 hate dislike against reject bad problem risk worry tired".split()
NEGATION = "不|没|别|不要|不用"

# CJK topics, words that are none, and verbs of speech
CJK_TOPICS = (
    "风格 技术 产品 用户 团队 方案 项目 市场 客户 需求 功能 接口 后端 前端 数据 代码 测试 部署 版本 升级 修改 更新 添加 删除 设计 原型 框架 天气 照片 日历 语音 插件 模块 配置 服务 安全 性能 文档 会议 评审 加班 "
    "进度 时间 预算 成本 质量 体验 效率 开发 运营 维护 支持 培训 分享 汇报 现代 简约 日式 原木 装修 路线 目标 计划 任务 事项 结果 管理 工具 平台 业务 流程 规定 政策"
).split()
CJK_TOPIC_STOP = (
    "我们 你们 他们 自己 这个 那个 什么 怎么 一个 可以 没有 不是 就是 因为 所以 但是 如果 还是 或者 已经 之后 之前 时候 地方 方案 项目 问题 工作 开始 完成 讨论 要求 设计 开发 进行 需要 实现 进度 版本 系统 "
    "内容 情况 结果 数据 信息 功能 部分 阶段"
).split()
CJK_SPEECH = "说过 认为 建议 推荐 表示".split()

# Corrections and lessons
CORRECTION_SIGNALS = "不是 不对 错了 应该是 不要 记住 我告诉过你 我说过 别 别再 你又 还说 no wrong don't stop hey remember".split() + ["i told you", "not", "never", "hold on", "wait", "actually", "correction"]
CORRECTION_IGNORE = (r"他\w*不", r"我不(知道|确定)", r"不太好", r"i don't (know|think)", r"not (sure|really|bad)", r"not bad")
LESSON_PATTERNS = (
    r"(?:不要|不准|别|别再)\s*(.+?)(?:[。，！？,.!?]|$)",
    r"应该\s*(.+?)[。，！？,.!?]",
    r"记住\s*(.+?)[。，！？,.!?]",
    r"正确的做法是\s*(.+?)[。，！？,.!?]",
    r"不是\s*(.+?)[。，！？,.!?]",
    r"不对\s*(.+?)[。，！？,.!?]",
    r"错了[，。！]?\s*(.+?)[。，！？,.!?]",
    r"(?:don't|do not|never|stop)\s+(.+?)[.,!?]",
    r"(?:remember|correct):?\s+(.+?)[.,!?]",
)

# Profile patterns (pattern, field)
PROFILE_PATTERNS = (
    (r"(?:我叫|我的名字叫|我是|叫我|你可以叫我|称呼我)\s*(.{1,8}?)(?:[，。、！？,\.!?\s]|$)", "name"),
    (r"(?:我在|我现在在|目前工作在|就职于)\s*(.{2,20}?)(?:工作|上班|任职|担任|，|。|$)", "company"),
    (r"(?:担任|从事|我的工作是|我的职业是|做|我是.{0,8}?的)\s*(.{2,12}?)(?:[，。、！？,\.!?\s]|$)", "job"),
    (r"(?:我(?:很|非常|特别|最)?(?:喜欢|热爱|偏爱|爱|钟爱|中意)\s*(.{2,30}?)(?:[，。、！？,\.!?\s]|$))", "likes"),
    (r"(?:我(?:很|非常|特别|最)?(?:讨厌|不喜欢|反感)\s*(.{2,30}?)(?:[，。、！？,\.!?\s]|$))", "dislikes"),
    (r"(?:我[住位]?(?:在|于)\s*(.{2,15}?)(?:[，。、！？,\.!?\s]|$))", "location"),
    (r"(?:我用|我用的是|我使用|一直以来用|常用的工具有)\s*(.{2,20}?)(?:[，。、！？,\.!?\s]|$)", "tools"),
    (r"(?:my name is|i am|i'm|call me|you can call me)\s+(.{1,20}?)(?:[,\.!?\s]|$)", "name"),
    (r"(?:i work at|i work for|i'm (?:a|an) (?:software|engineer|designer|writer|editor|developer|manager|researcher) at)\s+(.{2,30}?)(?:[,\.!?\s]|$)", "company"),
    (r"(?:i'm a|i am a|my job is|i work as)\s+(.{2,20}?)(?:[,\.!?\s]|$)", "job"),
    (r"(?:i (?:really |very |especially )?(?:like|love|enjoy|prefer)\s+(.{2,30}?)(?:[,\.!?\s]|$))", "likes"),
    (r"(?:i (?:really |very |especially )?(?:hate|dislike|don't like)\s+(.{2,30}?)(?:[,\.!?\s]|$))", "dislikes"),
    (r"(?:i (?:live|stay|work|am based)\s+(?:in|at)\s+(.{2,20}?)(?:[,\.!?\s]|$))", "location"),
    (r"(?:i use|my tools are|i work with)\s+(.{2,30}?)(?:[,\.!?\s]|$)", "tools"),
)
PROFILE_SKIP = "他 她 它 我 你 我们 你们 他们 这个 that this it them him her us".split()

# Knowledge-file scores
KB_EXACT, KB_PARTIAL, KB_FILENAME, KB_TOP = 10, 5, 3, 3
