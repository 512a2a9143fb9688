"""Tokens, chunks and annotations over fixtures."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dialects import dialect, parsed
from ..operators import bounds, chunks, headers, modify, validate
from .fixtures import golden, listed, once

EMPTY_TAGS, EMPTY_FLAGS = "cast(map() as map<string,string>)", "cast(array() as array<string>)"


def shown(tags: Column) -> Column:
    """A map as sorted ``key=value``."""
    return F.array_join(F.transform(F.array_sort(F.map_entries(tags)), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";")


def field(rows: str, name: str) -> Column:
    return listed(F.col(rows), lambda x: x[name])


def spans(column: str = "spans") -> Column:
    return listed(F.col(column), lambda s: F.concat(s["type"], F.lit(":"), s["start"], F.lit("-"), s["end"]), ",")


def cut(df: DataFrame, of: str, token: str = "given") -> DataFrame:
    return bounds.tokenised(parsed(df, of, token), carry=dialect(of).carried)


def with_annotations(df: DataFrame) -> DataFrame:
    none = lambda a: a.withField("tags", F.expr(EMPTY_TAGS)).withField("flags", F.expr(EMPTY_FLAGS))
    return df.withColumn("annos", F.transform("annos", none))


@golden("dipls utf annos simple errors spans", [
    ('foo', 'foo', 'foo', 'foo', 'foo', '', ''),
    ('foo|bar', 'foo|bar', 'foobar', 'foo| ~ bar', 'foo ~ bar', '', ''),
    ('test.', 'test.', 'test.', 'test ~ .', 'test ~ .', '', ''),
    ('f%.oo', 'f%.oo', 'f·oo', 'f%.oo', 'f.oo', '', ''),
    ('foo%.', 'foo%.', 'foo·', 'foo ~ %.', 'foo ~ .', '', ''),
    ('<wa>=<ren>', '<wa>= ~ <ren>', 'wa= ~ ren', '<wa>=<ren>', 'waren', '', 'Recognizable:0-4,Recognizable:5-10'),
    ('w[[a=]]ren', 'w[[a=]] ~ ren', 'w[...]= ~ ren', 'w[[a=]]ren', 'waren', '', 'EditorCompleted:1-7'),
    ('(")foo', '(")foo', 'foo', '(") ~ foo', '(") ~ foo', '', ''),
    ('foo(")', 'foo(")', 'foo', 'foo ~ (")', 'foo ~ (")', '', ''),
    ('foo(.)|bar', 'foo(.)|bar', 'foobar', 'foo(.)| ~ bar', 'foo(.) ~ bar', '', ''),
    ('a,.', 'a,.', 'a,.', 'a ~ , ~ .', 'a ~ , ~ .', '', ''),
    ('*1.', '*1.', '.', '*1 ~ .', ' ~ .', '', ''),
    ('foo#bar', 'foo# ~ bar', 'foo ~ bar', 'foo#bar', 'foobar', '', ''),
    ('*[foo*]', '*[foo*]', 'foo', '', '', '', 'Strikethrough:0-7'),
    ('$chon', '$chon', 'ſchon', '$chon', 'schon', '', ''),
    ('vn\\-', 'vn\\-', 'vn̄', 'vn\\-', 'vnd', '', ''),
    ('zer$panten', 'zer$panten', 'zerſpanten', 'zer$panten', 'zerspanten', '', ''),
    ('enpei$$en', 'enpei$$en', 'enpeiſſen', 'enpei$$en', 'enpeissen', '', ''),
    ('*[$we$ter*]', '*[$we$ter*]', 'ſweſter', '', '', '', 'Strikethrough:0-11'),
    ('hymel(=)\nreich', 'hymel(=) ~ reich', 'hymel ~ reich', 'hymel(=)reich', 'hymelreich', '', ''),
    ('hymel(=)|reich', 'hymel(=) ~ |reich', 'hymel ~ reich', 'hymel(=)| ~ reich', 'hymel ~ reich', 'contradictory_bounds', ''),
    ('hymel|(=)reich', 'hymel|(=) ~ reich', 'hymel ~ reich', 'hymel| ~ (=)reich', 'hymel ~ reich', 'contradictory_bounds,not_at_line_end', ''),
    ('dy\\:|es', 'dy\\:|es', 'dÿes', 'dy\\:| ~ es', 'dy ~ es', '', ''),
    ('fraw\\.', 'fraw\\.', 'fraẇ', 'fraw\\.', 'fraw', '', ''),
    ('<...>', '<...>', '...', '<...>', '...', '', 'Recognizable:0-5'),
    ('tok#en.iza|tion%....', 'tok# ~ en.iza|tion%....', 'tok ~ en.ization·...', 'tok#en.iza| ~ tion ~ %. ~ ...', 'token.iza ~ tion ~ . ~ ...', '', ''),
    ('token(=)\nizat=\nion.', 'token(=) ~ izat= ~ ion.', 'token ~ izat= ~ ion.', 'token(=)izat=ion ~ .', 'tokenization ~ .', '', ''),
    ('de%$', 'de%$', 'deſ', 'de%$', 'des', '', ''),
    ('*[wi(=)\nder*]', '*[wi(=) ~ der*]', 'wi ~ der', '*[wi(=)der*]', '', 'bracket_open_at_line_end', 'Strikethrough:0-13'),
    ('[[ge(=)]]\ntan', '[[ge(=)]] ~ tan', '[...] ~ tan', '[[ge(=)]]tan', 'getan', 'not_at_line_end', 'EditorCompleted:0-9'),
    ('er$<ch>(=)<ain>', 'er$<ch>(=) ~ <ain>', 'erſch ~ ain', 'er$<ch>(=)<ain>', 'erschain', 'not_at_line_end', 'Recognizable:3-7,Recognizable:10-15'),
    ('h<.$.>', 'h<.$.>', 'h.ſ.', 'h ~ <.$.>', 'h ~ .s.', '', 'Recognizable:1-6'),
    ('eyn<s></>(.)', 'eyn<s></>(.)', 'eyns/', 'eyn<s> ~ </> ~ (.)', 'eyns ~ / ~ (.)', '', 'Recognizable:3-6,Recognizable:6-9'),
    ('*{D*}iz', '*{D*}iz', 'Diz', '*{D*}iz', 'Diz', '', ''),
    ('*{I*3}n', '*{I*3}n', 'In', '*{I*3}n', 'In', '', ''),
    ('$wer[t]', '$wer[t]', 'ſwer[...]', '$wer[t]', 'swert', '', 'FromEdition:4-7'),
    ('$wer[[t]]', '$wer[[t]]', 'ſwer[...]', '$wer[[t]]', 'swert', '', 'EditorCompleted:4-9'),
    ('foo<<...>>', 'foo<<...>>', 'foo[...]', 'foo<<...>>', 'foo', '', ''),
    ('foo...', 'foo...', 'foo...', 'foo ~ ...', 'foo ~ ...', '', ''),
    ('test[..]', 'test[..]', 'test[...]', 'test[..]', 'test..', '', 'FromEdition:4-8'),
    ('test[.]', 'test[.]', 'test[...]', 'test ~ [.]', 'test ~ .', '', 'FromEdition:4-7'),
    ('test<.>', 'test<.>', 'test.', 'test ~ <.>', 'test ~ .', '', 'Recognizable:4-7'),
    ('meinenn/', 'meinenn/', 'meinenn/', 'meinenn ~ /', 'meinenn ~ /', '', ''),
    ('mei(=)\n/nenn', 'mei(=) ~ /nenn', 'mei ~ /nenn', 'mei(=)/nenn', 'mei/nenn', '', ''),
    ('.xij.', '.xij.', '.xij.', '.xij.', '.xij.', '', ''),
    ('oli<ueti>%.', 'oli<ueti>%.', 'oliueti·', 'oli<ueti> ~ %.', 'oliueti ~ .', '', 'Recognizable:3-9'),
    ('dz.(=)\n$elbe\\-', 'dz.(=) ~ $elbe\\-', 'dz. ~ ſelbē', 'dz.(=)$elbe\\-', 'dz.selben', '', ''),
    ('(")owe', '(")owe', 'owe', '(") ~ owe', '(") ~ owe', '', ''),
    ('(")o', '(")o', 'o', '(") ~ o', '(") ~ o', '', ''),
    ('wi$$e[n].(.)', 'wi$$e[n].(.)', 'wiſſe[...].', 'wi$$e[n] ~ . ~ (.)', 'wissen ~ . ~ (.)', '', 'FromEdition:5-8'),
    ('t[ok]en.(?)', 't[ok]en.(?)', 't[...]en.', 't[ok]en ~ . ~ (?)', 'token ~ . ~ (?)', '', 'FromEdition:1-5'),
    ('ma=\nria', 'ma= ~ ria', 'ma= ~ ria', 'ma=ria', 'maria', '', ''),
    ('foo bar', 'foobar', 'foobar', 'foobar', 'foobar', 'invalid_characters: ', ''),
    ('*C*fJtem', '*C*fJtem', '\uf1e1Jtem', '*C ~ *fJtem', '// ~ Jtem', '', ''),
    ('different(=)text', 'different(=) ~ text', 'different ~ text', 'different(=)text', 'differenttext', 'not_at_line_end', ''),
    ('different(=)\ntext', 'different(=) ~ text', 'different ~ text', 'different(=)text', 'differenttext', '', ''),
    ('foo=|\nbar', 'foo=| ~ bar', 'foo= ~ bar', 'foo=| ~ bar', 'foo ~ bar', '', ''),
    ('foo|=\nbar', 'foo|= ~ bar', 'foo= ~ bar', 'foo| ~ =bar', 'foo ~ bar', 'erroneous_bound', ''),
    ('foo(=)|\nbar', 'foo(=) ~ |bar', 'foo ~ bar', 'foo(=)| ~ bar', 'foo ~ bar', 'contradictory_bounds', ''),
    ('foo|(=)\nbar', 'foo|(=) ~ bar', 'foo ~ bar', 'foo| ~ (=)bar', 'foo ~ bar', 'contradictory_bounds', ''),
    ('foo[=]\nbar', 'foo[=] ~ bar', 'foo[...]= ~ bar', 'foo[=]bar', 'foobar', '', 'FromEdition:3-6'),
    ('[foo][=]\nbar', '[foo][=] ~ bar', '[...][...]= ~ bar', '[foo][=]bar', 'foobar', '', 'FromEdition:0-5,FromEdition:5-8'),
    ('foo[=]\n[bar]', 'foo[=] ~ [bar]', 'foo[...]= ~ [...]', 'foo[=][bar]', 'foobar', '', 'FromEdition:3-6,FromEdition:7-12'),
    ('[[foo]][[=]]\n[bar]', '[[foo]][[=]] ~ [bar]', '[...][...]= ~ [...]', '[[foo]][[=]][bar]', 'foobar', '', 'EditorCompleted:0-7,EditorCompleted:7-12,FromEdition:13-18'),
    ('Sig<=>\nmundt', 'Sig<=> ~ mundt', 'Sig= ~ mundt', 'Sig<=>mundt', 'Sigmundt', '', 'Recognizable:3-6'),
    ('genome\\-*2(,)|etwas', 'genome\\-*2(,)|etwas', 'genomēetwas', 'genome\\-*2(,)| ~ etwas', 'genomen(,) ~ etwas', '', ''),
    ('foo[', 'foo[', 'foo[...]', 'foo[', 'foo', 'bracket_not_closed', ''),
    ('foo]', 'foo]', 'foo', 'foo]', 'foo', 'bracket_not_opened', ''),
    ('<a[b>c]', '<a[b>c]', 'a[...]', '<a[b>c]', 'abc', '', 'Recognizable:0-5,FromEdition:2-7'),
    ('a&(b&)c', 'a&(b&)c', 'a(b)c', 'a&(b&)c', 'a(b)c', '', ''),
    ('%M.%g', '%M.%g', '%M.ᷚ', '%M.%g', '%M.g', '', ''),
    ('x(,,)y', 'x(,,)y', 'x(y', 'x( ~ ,,)y', 'x( ~ ,,)y', 'invalid_characters:(', ''),
    ('a,,)b', 'a,,)b', 'ab', 'a ~ ,,)b', 'a ~ ,,)b', '', ''),
    ('a_b€', 'a_b€', 'a\u200db€', 'a_b€', 'ab€', 'invalid_characters:€', ''),
    ('%[A', '%[A', '%[...]', '%[A', '%A', 'bracket_not_closed', ''),
    ('&9cz&7', '&9cz&7', 'ꝯcz\uf158', '&9cz&7', 'conczet', '', ''),
    ('d_e%9', 'd_e%9', 'dᵉꝰ', 'd_e%9', 'deus', '', ''),
])
def rex_tokens(df: DataFrame) -> DataFrame:
    """Tokens through the regular dialects' signs, both tokenisations, their forms, and all errors."""

    def made(t: DataFrame) -> DataFrame:
        return cut(t, "anselm").select(
            "given", field("dipls", "trans").alias("dipls"), field("dipls", "utf").alias("utf"), field("annos", "trans").alias("annos"),
            field("annos", "simple").alias("simple"), listed(validate.token_errors(), sep=",").alias("errors"), spans().alias("spans"),
        )

    return once(df, made)


@golden("dipls annos errors", [
    ('rem a°b', 'a°b', 'a°b', ''),
    ('anselm a°b', 'a°b', 'a°b', 'invalid_characters:°'),
    ('ref a(b)', 'a(b)', 'a(b)', ''),
    ('anselm a(b)', 'a(b)', 'a(b)', 'invalid_characters:()'),
    ('ref «a»', '«a»', '«a»', ''),
    ('anselm «a', '«a', '«a', 'invalid_characters:«'),
    ('redi a\\&12', 'a\\&12', 'a\\&12', ''),
    ('anselm a\\&12', 'a\\&12', 'a\\&12', 'invalid_characters:{}'),
    ('anselm a\\&2', 'a\\&2', 'a\\&2', ''),
    ('redi (")mensch', '(")mensch', '(") ~ mensch', ''),
    ('plain t[ok]en.(?)', 't[ok]en.(?)', 't[ok]en.(?)', ''),
    ('plain a b', 'ab', 'ab', 'blank_in_token'),
    ('rem string·string', 'string·string', 'string·string', ''),
    ('rem string∙string', 'string∙string', 'string∙string', ''),
    ("ref Ritt'=liche\\-/", "Ritt'= ~ liche\\-/", "Ritt'=liche\\- ~ /", ''),
    ('ref *[vordír/*](.)', '*[vordír/*](.)', '*[vordír ~ /*] ~ (.)', ''),
    ('redi [[...]]', '[[...]]', '[[...]]', ''),
    ('redi [[........]]', '[[........]]', '[[........]]', ''),
    ('redi [[STARB]]', '[[STARB]]', '[[STARB]]', ''),
    ('redi wir[[d]]', 'wir[[d]]', 'wir[[d]]', ''),
    ('redi vn[[d]]e', 'vn[[d]]e', 'vn[[d]]e', ''),
    ('redi KOBE[[R]][[..]]', 'KOBE[[R]][[..]]', 'KOBE[[R]][[..]]', ''),
    ('anselm a&éb', 'a&éb', 'a&éb', ''),
    ('plain x\ny', 'xy', 'xy', ''),
])
def dialect_tokens(df: DataFrame) -> DataFrame:
    """Tokens that dialects take differently; an input begins with its dialect."""

    def made(t: DataFrame) -> DataFrame:
        split = t.withColumn("of", F.split_part("given", F.lit(" "), F.lit(1))).withColumn("token", F.expr("substring(given, length(of) + 2)"))
        rows = [cut(split.where(F.col("of") == name), name, "token") for name in ("plain", "rem", "ref", "anselm", "redi")]
        both = functools.reduce(DataFrame.unionByName, rows)
        return both.select("given", field("dipls", "trans").alias("dipls"), field("annos", "trans").alias("annos"), listed(validate.token_errors(), sep=",").alias("errors"))

    return once(df, made)


@golden("classes dipls simple errors spans", [
    ('foo#bar', 'TextChar TextChar TextChar Univerbation TextChar TextChar TextChar', 'foo ~ bar', 'foobar', '', ''),
    ('x§y', 'TextChar Multiverbation TextChar', 'xy', 'x ~ y', '', ''),
    ('ab§c#d', 'TextChar TextChar Multiverbation TextChar Univerbation TextChar', 'abc ~ d', 'ab ~ cd', '', ''),
    ('ǂdeǂ', 'Strikethrough TextChar TextChar Strikethrough', 'de', 'de', '', 'Strikethrough:0-4'),
    ('ǂdeǂf', 'Strikethrough TextChar TextChar Strikethrough TextChar', 'f', 'f', '', 'Strikethrough:0-4'),
    ('{L_ab}c', 'ExpandedAbbreviation TextChar TextChar ExpandedAbbreviation TextChar', 'abc', 'abc', '', 'ExpandedAbbreviation:0-6'),
    ('a*LN_note*b', 'TextChar Note TextChar TextChar TextChar TextChar Note TextChar', 'anoteb', 'anoteb', '', 'Note:1-10'),
    ('*OK_x*y', 'Correction TextChar Correction TextChar', 'xy', 'xy', '', 'Correction:0-6'),
    ('*RE_add*', 'Addition TextChar TextChar TextChar Addition', 'add', 'add', '', 'Addition:0-8'),
    ('\\FU_ab\\c', 'Continuation TextChar TextChar Continuation TextChar', 'abc', 'abc', '', 'Continuation:0-7'),
    ('$Lücke$', 'Lacuna', '$Lücke$', '$Lücke$', '', ''),
    ('$ein comment$', 'Comment', '$ein comment$', '$ein comment$', '', ''),
    ('a[…]b', 'TextChar IllegibleChar TextChar', 'a…b', 'a…b', '', ''),
    ('[ab]c', 'Recognizable TextChar TextChar Recognizable TextChar', 'abc', 'abc', '', 'Recognizable:0-4'),
    ('a-b', 'TextChar Hyphen TextChar', 'a-b', 'ab', '', ''),
    ('a=b', 'TextChar Hyphen TextChar', 'a=b', 'ab', '', ''),
    ('a]b', 'TextChar', 'a', 'a', 'not_parsed', ''),
    ('a{L_b', 'TextChar ExpandedAbbreviation TextChar', 'a{L_b', 'a{L_b', 'not_parsed', ''),
    ('foo\nbar', 'TextChar TextChar TextChar LineBreak TextChar TextChar TextChar', 'foo ~ bar', 'foobar', '', ''),
    ('a b', 'TextChar Whitespace TextChar', 'a ~ b', 'ab', '', ''),
    ('ǂaǂ§b', 'Strikethrough TextChar Strikethrough Multiverbation TextChar', 'b', ' ~ b', '', 'Strikethrough:0-3'),
    ('¶1', 'TextChar TextChar', '¶1', '¶1', '', ''),
    ('a.b', 'TextChar Punct TextChar', 'a.b', 'a.b', '', ''),
    ('x[{A_y}]z', 'TextChar Recognizable ExpandedAbbreviation TextChar ExpandedAbbreviation Recognizable TextChar', 'xyz', 'xyz', '', 'ExpandedAbbreviation:2-7,Recognizable:1-8'),
    ('[{A_y]}', 'Recognizable ExpandedAbbreviation TextChar', '[{A_y', '[{A_y', 'not_parsed', ''),
])
def ren_tokens(df: DataFrame) -> DataFrame:
    """Tokens of the ReN dialect: brackets with a stack, carried bounds, deleted text without forms."""

    def made(t: DataFrame) -> DataFrame:
        return cut(t, "ren").select(
            "given", listed(F.col("chars"), lambda c: c["cls"], " ").alias("classes"), field("dipls", "utf").alias("dipls"), field("annos", "simple").alias("simple"),
            listed(F.col("lexical"), sep=",").alias("errors"), spans().alias("spans"),
        )

    return once(df, made)


@golden("utf simple", [
    ('$', 'ſ', 's'),
    ('%9', 'ꝰ', 'us'),
    ('%2', '᷑', 'ur'),
    ('&3', 'ꝫ', 'et'),
    ('{&3', '{&3', '{und3'),
    ('&4a', 'ꝝa', 'ruma'),
    ('&7', '\uf158', 'et'),
    ('&9', 'ꝯ', 'con'),
    ('%%a', 'ᵃ', 'ra'),
    ('%%ö', 'ᵒ', 'ro'),
    ('%%v', 'ᵛ', 'rv'),
    ('ct', 'ct', 'ct'),
    ("c%'", 'c͛', 'cetera'),
    ('e\\,', 'ę', 'e'),
    ('E\\,', 'Ę', 'E'),
    ("v'", 'vˢ', 'ver'),
    ("er'", 'eˢ', 'eer'),
    ("r'", 'ˢ', 'er'),
    ("'r", 'ˢr', 'er'),
    ("a'", 'aˢ', 'ar'),
    ("'a", 'ˢa', 'ra'),
    ("b'", 'bˢ', 'ber'),
    ("\\'a", '́a', 'a'),
    ('q\\/', 'ꝙ', 'que'),
    ('Q\\/', 'Ꝙ', 'Que'),
    ('p\\/', 'p', 'pro'),
    ('P\\/', 'P', 'Pro'),
    ('p\\/_p', 'p\u200dp', 'prop'),
    ('\\/', '', '-'),
    ('p\\_', 'ꝑ', 'per'),
    ('P\\_', 'Ꝑ', 'Per'),
    ('q_2', '\ue8b3', 'quia'),
    ('a_3', 'a', 'aus'),
    ('*C', '\uf1e1', '//'),
    ('·', '·', '.'),
    ('%.', '·', '.'),
    ('\\.\\7', '̇\\7', '\\7'),
    ('∙', '·', '.'),
    ('%.ab%.', '%.ab%.', '.ab.'),
    ('%.a%.', '%.a%.', '.a.'),
    ('.$.', '.ſ.', '.s.'),
    ('a\\`', 'à', 'a'),
    ("a\\'", 'á', 'a'),
    ('a\\^', 'â', 'a'),
    ('%-', '̄', '-'),
    ('a\\_', 'a̲', 'a'),
    ('a\\.', 'ȧ', 'a'),
    ('a\\:', 'ä', 'a'),
    ('vn\\-', 'vn̄', 'vnd'),
    ('VN\\-', 'VN̄', 'VND'),
    ('n\\-', 'n̄', 'en'),
    ('m\\-', 'm̄', 'em'),
    ('an\\-', 'an̄', 'an'),
    ('bn\\-', 'bn̄', 'ben'),
    ('a\\-m', 'ām', 'am'),
    ('a\\-b', 'āb', 'anb'),
    ('b\\-n', 'b̄n', 'ben'),
    ('b\\-t', 'b̄t', 'bent'),
    ('A\\-M', 'ĀM', 'AM'),
    ('A\\-B', 'ĀB', 'ANB'),
    ('B\\-N', 'B̄N', 'BEN'),
    ('B\\-T', 'B̄T', 'BENT'),
    ('d_e', 'dᵉ', 'de'),
    ('p_p', '', 'pp'),
    ('a_b', 'a\u200db', 'ab'),
    ('o\\e', 'oͤ', 'oe'),
    ('u%o', 'uͦ', 'uo'),
    ('a\\c', 'aͨ', 'ac'),
    ('a\\d', 'aͩ', 'ad'),
    ('a\\h', 'aͪ', 'ah'),
    ('a\\x', 'aͯ', 'ax'),
    ('a\\*', 'a͗', 'a'),
    ('a\\g', 'aᷚ', 'ag'),
    ('a%k', 'aᷜ', 'ak'),
    ('a\\l', 'aᷝ', 'al'),
    ('a\\n', 'aᷠ', 'an'),
    ('a\\z', 'aᷦ', 'az'),
    ('a\\$', 'aſ', 'as'),
    ('a\\b', 'a\uf012', 'ab'),
    ('a%f', 'a\uf017', 'af'),
    ('a\\y', 'a\uf02b', 'ay'),
    ('a\\j', 'a\uf030', 'aj'),
    ('a\\q', 'a\uf033', 'aq'),
    ('a%w', 'a\uf03c', 'aw'),
    ('âêîôû', 'âêîôû', 'aeiou'),
    ('ÁÉÍÓÚÝ', 'ÁÉÍÓÚÝ', 'AEIOUY'),
    ('æÆ', 'æÆ', 'aeAe'),
    ('&&', '&', 'und'),
    ('&', '&', 'und'),
    ('\\&99', '□', '{99}'),
    ('\\&10', '⑩', '{10}'),
    ('\\&35', '㉟', '{35}'),
    ('\\&1', '①', '{1}'),
    ('\\&9a', '⑨a', '{9}a'),
])
def replaced_signs(df: DataFrame) -> DataFrame:
    """Signs of the table of replacements, some told apart by what stands around them."""
    made = lambda t: parsed(t, "anselm", "given").select("given", bounds.form(F.col("chars"), "dipl_utf").alias("utf"), bounds.form(F.col("chars"), "anno_simple").alias("simple"))  # noqa: E731, E501
    return once(df, made)


def _stream(t: DataFrame, redi: bool) -> DataFrame:
    stream = chunks.chunks(t, "given", "given", redi)
    said = F.concat_ws(":", "kind", "type", F.translate("content", "\n\t", "⏎⇥"))
    return stream.groupBy("given").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk_ord", said.alias("s")))), lambda x: x["s"]), " ").alias("chunks"))


@golden("chunks", [
    ('noch ein+K test @K', 'token:noch space:  token:ein comment:K:test'),
    ("zu Jn mannen(.) +K mannen(.): folgt Schnörkel @K +K 20v,01: 'hagel' üdZ @K", "token:zu space:  token:Jn space:  token:mannen(.) space:  comment:K:mannen(.): folgt Schnörkel space:  comment:K:20v,01: 'hagel' üdZ"),
    ('different(=)\ntext', 'token:different(=)⏎text'),
    ('foo=\nbar bla', 'token:foo=⏎bar space:  token:bla'),
    ('foo=|\nbar bla', 'token:foo=|⏎bar space:  token:bla'),
    ('foo[=]\nbar\n[foo][=]\nbar\nfoo[=]\n[bar]\n[[foo]][[=]]\nbar', 'token:foo[=]⏎bar newline:⏎ token:[foo][=]⏎bar newline:⏎ token:foo[=]⏎[bar] newline:⏎ token:[[foo]][[=]]⏎bar'),
    ('edition numbering {5} here\nhere {9} words\nhere {1vf,2} too\nlook {Kap.6,I} here\nnext {Str 7,X} one {V.10,V}', 'token:edition space:  token:numbering space:  comment:Z:{5} space:  token:here newline:⏎ token:here space:  comment:Z:{9} space:  token:words newline:⏎ token:here space:  comment:Z:{1vf,2} space:  token:too newline:⏎ token:look space:  comment:Z:{Kap.6,I} space:  token:here newline:⏎ token:next space:  comment:Z:{Str 7,X} space:  token:one space:  comment:Z:{V.10,V}'),
    ('owe\n alsdkfj', 'token:owe newline:⏎ token:alsdkfj'),
    ('+L some latin text @L', 'open:L:+L space:  token:some space:  token:latin space:  token:text space:  close:L:@L'),
    ('test *[was*]\nwords and *[est*] more\n*[t*] see another', 'token:test space:  token:*[was*] newline:⏎ token:words space:  token:and space:  token:*[est*] space:  token:more newline:⏎ token:*[t*] space:  token:see space:  token:another'),
    ('a\tb \n\n c', 'token:a space:⇥ token:b space:  newline:⏎ newline:⏎ token:c'),
    ('+Fp x @Fp +Ü T @Ü', 'open:Fp:+Fp space:  token:x space:  close:Fp:@Fp space:  open:Ü:+Ü space:  token:T space:  close:Ü:@Ü'),
    ('a@b c+d {12}e', 'token:a token:b space:  token:c token:d space:  comment:Z:{12} token:e'),
    ('+E not closed', 'token:E space:  token:not space:  token:closed'),
    ('a=\nb=\nc', 'token:a=⏎b= newline:⏎ token:c'),
    ('{*1*} {}', 'token:*1*} space:  token:}'),
    ('x(=) \n\ty', 'token:x(=) ⏎⇥y'),
])
def chunk_stream(df: DataFrame) -> DataFrame:
    """Chunks of every kind in order."""
    return once(df, lambda t: _stream(t, False))


@golden("chunks", [
    ('noch ein+K test @K', 'token:noch space:  token:ein+K space:  token:test space:  token:@K'),
    ("zu Jn mannen(.) +K mannen(.): folgt Schnörkel @K +K 20v,01: 'hagel' üdZ @K", "token:zu space:  token:Jn space:  token:mannen(.) space:  comment:K:mannen(.): folgt Schnörkel space:  comment:K:20v,01: 'hagel' üdZ"),
    ('different(=)\ntext', 'token:different(=)⏎text'),
    ('foo=\nbar bla', 'token:foo=⏎bar space:  token:bla'),
    ('foo=|\nbar bla', 'token:foo=|⏎bar space:  token:bla'),
    ('foo[=]\nbar\n[foo][=]\nbar\nfoo[=]\n[bar]\n[[foo]][[=]]\nbar', 'token:foo[=]⏎bar newline:⏎ token:[foo][=]⏎bar newline:⏎ token:foo[=]⏎[bar] newline:⏎ token:[[foo]][[=]]⏎bar'),
    ('edition numbering {5} here\nhere {9} words\nhere {1vf,2} too\nlook {Kap.6,I} here\nnext {Str 7,X} one {V.10,V}', 'token:edition space:  token:numbering space:  token:{5} space:  token:here newline:⏎ token:here space:  token:{9} space:  token:words newline:⏎ token:here space:  comment:Z:{1vf,2} space:  token:too newline:⏎ token:look space:  comment:Z:{Kap.6,I} space:  token:here newline:⏎ token:next space:  comment:Z:{Str 7,X} space:  token:one space:  comment:Z:{V.10,V}'),
    ('owe\n alsdkfj', 'token:owe newline:⏎ token:alsdkfj'),
    ('+L some latin text @L', 'open:L:+L space:  token:some space:  token:latin space:  token:text space:  close:L:@L'),
    ('test *[was*]\nwords and *[est*] more\n*[t*] see another', 'token:test space:  token:*[was*] newline:⏎ token:words space:  token:and space:  token:*[est*] space:  token:more newline:⏎ token:*[t*] space:  token:see space:  token:another'),
    ('a\tb \n\n c', 'token:a space:⇥ token:b space:  newline:⏎ newline:⏎ token:c'),
    ('+Fp x @Fp +Ü T @Ü', 'open:Fp:+Fp space:  token:x space:  close:Fp:@Fp space:  open:Ü:+Ü space:  token:T space:  close:Ü:@Ü'),
    ('a@b c+d {12}e', 'token:a@b space:  token:c+d space:  token:{12} token:e'),
    ('+E not closed', 'token:+E space:  token:not space:  token:closed'),
    ('a=\nb=\nc', 'token:a=⏎b= newline:⏎ token:c'),
    ('{*1*} {}', 'token:*1*} space:  token:}'),
    ('x(=) \n\ty', 'token:x(=) ⏎⇥y'),
])
def redi_chunk_stream(df: DataFrame) -> DataFrame:
    """The same texts in the ReDI dialect: numbers in braces are tokens, plus and at signs may stand inside tokens."""
    return once(df, lambda t: _stream(t, True))


@golden("errors", [
    ('foo|bar foo|bar foo|~bar', ''),
    ('foo|bar foo|bar foobar', 'err_cat_anno,err_nr_anno'),
    ('foo|bar foo|bar -', 'err_nr_anno'),
    ('foo|bar - -', 'err_no_pieces,err_cat_dipl,err_nr_dipl,err_nr_anno'),
    ('foo#bar foo#bar foo#bar', 'err_nr_dipl'),
    ('foo#bar foo#~bar foo#bar', ''),
    ('foo#bar fo~o#bar foo#bar', 'err_tok_dipl'),
    ('foo. foo. foo~.', ''),
    ('foo. foo. fo~o.', 'err_tok_anno'),
    ('foo. foo. foo.', 'err_nr_anno'),
    ('foo. fo. foo~.', 'err_cat_dipl,err_cat_anno,err_tok_dipl'),
    ('hin#czü|hin(.) hin#czü|~hin hin#czü|~hin~(.)', 'err_cat_dipl,err_cat_anno,err_tok_dipl'),
    ('her#aws her#aws her#aws', 'err_nr_dipl'),
    ('a[b a[b a[b', 'bracket_not_closed'),
    ('*[foo*] *[foo*] -', ''),
])
def given_pieces(df: DataFrame) -> DataFrame:
    """Given pieces held against the parsed ones: token, its dipls, its annos, each cut at tildes."""

    def made(t: DataFrame) -> DataFrame:
        part = lambda i: F.split_part("given", F.lit(" "), F.lit(i))
        several = lambda i: F.when(part(i) == "-", F.expr(EMPTY_FLAGS)).otherwise(F.split(part(i), "~"))
        rows = t.select("given", part(1).alias("trans"), several(2).alias("given_dipls"), several(3).alias("given_annos"))
        rows = cut(rows, "anselm", "trans").withColumn("errors", validate.token_errors())
        return validate.against_parse(rows).select("given", F.array_join("errors", ",").alias("errors"))

    return once(df, made)


@golden("token_types", [
    ('a', '-'),
    ('a|b', 'MS1 ~ MS2'),
    ('a|b|c', 'MS1 ~ MS2 ~ -'),
    ('a|b|c|d', 'MS1 ~ MS2 ~ MS1 ~ MS4'),
    ('a|b.|c', 'MS1 ~ MS2 ~ MS1 ~ MS4'),
    ('x#y=z', 'US UH'),
    ('x#y|z=w', 'MS1 US ~ MS2 UH'),
    ('foo=|\nbar', 'ML1 ~ ML2'),
    ('foo(=)\nbar', 'UL'),
    ('a|b|c|d|e|f', 'MS1 ~ MS2 ~ MS1 ~ MS4 ~ MS1 ~ MS6'),
    ('foo=|\nbar|baz|q', 'ML1 ~ ML2 ~ MS1 ~ MS4'),
    ('(")a|b', '- ~ MS1 ~ MS2'),
])
def token_types(df: DataFrame) -> DataFrame:
    """Tags of split and joined words, behind what the tag had before."""

    def made(t: DataFrame) -> DataFrame:
        rows = with_annotations(cut(t, "anselm")).withColumn("annos", modify.verbation_tags(F.col("annos")))
        return rows.select("given", listed(F.col("annos"), lambda a: F.coalesce(modify.get(a["tags"], "token_type"), F.lit("-"))).alias("token_types"))

    return once(df, made)


@golden("annos", [
    ('briffs(,)', 'briffs punc=(,) punc'),
    ('(")owe', 'owe punc=(") | punc'),
    ('(")owe(,)', 'owe punc=(") | (,) punc'),
    ('mir(?)(")', 'mir punc=(?) (") punc'),
    ('(.)', ''),
    ('a(.)|b(,)', 'a(.)|   ~ b punc=(,) punc'),
    ('ab', 'ab  '),
    ('a.(.)', 'a   ~ . punc=(.) punc'),
])
def sentence_marks(df: DataFrame) -> DataFrame:
    """Sentence marks as tag and flag of the anno before them, leading ones of the first one."""

    def made(t: DataFrame) -> DataFrame:
        rows = with_annotations(cut(t, "ref")).withColumn("annos", modify.punct_fold(F.col("annos")))
        said = lambda a: F.concat(a["trans"], F.lit(" "), shown(a["tags"]), F.lit(" "), F.array_join(a["flags"], ","))
        return rows.select("given", listed(F.col("annos"), said).alias("annos"))

    return once(df, made)


@golden("brackets rest struck n punct", [
    ('<a>.', '<>', 'a.', '<A>.', '4', 'true'),
    ('foo', '', 'foo', 'FOO', '3', 'false'),
    ('*[a*]b[c]', '*[*][]', 'abc', '*[A*]B[C]', '7', 'false'),
    ('a(.)b', '', 'ab', 'A(.)B', '3', 'false'),
    ('a&(b&)', '&(&)', 'ab', 'A&(B&)', '4', 'false'),
    ('*{D*}iz', '', '*{D*}iz', '*{D*}IZ', '3', 'false'),
    ('<<...>>a=b', '', 'a=b', '<<...>>A=B', '4', 'false'),
])
def kept_signs(df: DataFrame) -> DataFrame:
    """Characters kept, dropped, changed and counted by class."""

    def made(t: DataFrame) -> DataFrame:
        chars = F.col("chars")
        upper = bounds.mapped(chars, lambda c: c.withField("string", F.upper(c["string"])), lambda c: bounds.is_a(c["mask"], "TextChar"))
        return parsed(t, "anselm", "given").select(
            "given", bounds.form(bounds.keep(chars, "Bracket"), "string").alias("brackets"), bounds.form(bounds.keep(chars, "MetaChar", drop=True), "string").alias("rest"),
            bounds.form(upper, "string").alias("struck"), F.size(chars).cast("string").alias("n"), bounds.has(chars, "Punct").cast("string").alias("punct"),
        )

    return once(df, made)


@golden("sigle header", [
    ('Sigle: M1_a\nx:1:2\nx:3\nplain', 'M1', 'Sigle= M1_a;plain=;x=3'),
    ('', '-', ''),
    ('no', '-', 'no='),
    ('a:b\nText: T9_1x', 'T9', 'Text= T9_1x;a=b'),
    ('Titel:  Äpfel_x', 'Äpfel', 'Titel=  Äpfel_x'),
    ('k:', '-', 'k='),
    ('ab c: word two', 'word', 'ab c= word two'),
])
def headers_parsed(df: DataFrame) -> DataFrame:
    """Sigles and entries of headers."""
    entries = F.transform(F.array_sort(F.map_entries(headers.parse_header(F.col("given")))), lambda e: F.concat(e["key"], F.lit("="), F.array_join(e["value"], "/")))
    return df.select("doc_id", F.coalesce(headers.sigle(F.col("given")), F.lit("-")).alias("sigle"), F.array_join(entries, ";").alias("header"))


@golden("header", [
    ('Korpus-Sigle: F019, IV-Ba-P1 (H)\nTitel: T\nDruckort: Ulm\nAuswahl Referenzkorpus: 1r\nErgänzung Referenzkorpus: 2v', 'language-area: oberrheinisch | language-region: westoberdeutsch | language-type: oberdeutsch | genre: P | medium: Handschrift | time: 16,1 | reference: Hs.: Blatt (r/v), Kolumne (a/b), Zeile | corpus-sigle: F019, IV-Ba-P1 (H) | text: T | text-author: - | text-type: - | assignment_quality: - | hoffmann_wetter_nr: - | library: - | library-shelfmark: - | date: - | place: - | text-place: Ulm | printer: - | edition: - | literature: - | size: - | language: fnhd | corpus: ReF.BO | notes-transcription: a note | abbr_ddd: ABC | extent: FnhdC: -; compl: 1r, 2v | extent-size: FnhdC: -; compl: -'),
    ('Titel: ---', 'corpus-sigle: - | text: - | text-author: - | text-type: - | assignment_quality: - | hoffmann_wetter_nr: - | library: - | library-shelfmark: - | date: - | place: - | text-place: - | printer: - | edition: - | literature: - | size: - | language: fnhd | corpus: ReF.BO | notes-transcription: - | abbr_ddd: - | extent: FnhdC: -; compl: - | extent-size: FnhdC: -; compl: -'),
    ('Korpus-Sigle: F123, I-Ccd-V2, D\nTextsorte: Vers\nDruckort: Köln\nGesamtumfang: 100\nUmfang in Wortformen (Frnhd. Korpus): 20', 'language-area: hessisch-südrheinfränkisch | language-region: westmitteldeutsch | language-type: mitteldeutsch | genre: V | medium: Druck | time: 14,2 | reference: Seite, Zeile | corpus-sigle: F123, I-Ccd-V2, D | text: - | text-author: - | text-type: Vers | assignment_quality: - | hoffmann_wetter_nr: - | library: - | library-shelfmark: - | date: - | place: Köln | text-place: - | printer: - | edition: - | literature: - | size: 100 | language: fnhd | corpus: ReF.BO | notes-transcription: other | abbr_ddd: - | extent: FnhdC: -; compl: - | extent-size: FnhdC: 20; compl: -'),
    ('Korpus-Sigle: F7 V-Ca-T(H\nTextßorte: x\nLiteratur: y: z\nSchreibort: Trier', 'language-area: ripuarisch | language-region: westmitteldeutsch | language-type: mitteldeutsch | genre: T | medium: Handschrift | time: 16,2 | reference: Hs.: Blatt (r/v), Kolumne (a/b), Zeile | corpus-sigle: F7 V-Ca-T(H | text: - | text-author: - | text-type: - | assignment_quality: - | hoffmann_wetter_nr: - | library: - | library-shelfmark: - | date: - | place: - | text-place: Trier | printer: - | edition: - | literature: y: z | size: - | language: fnhd | corpus: ReF.BO | notes-transcription: - | abbr_ddd: - | extent: FnhdC: -; compl: - | extent-size: FnhdC: -; compl: -'),
    ('', 'corpus-sigle: - | text: - | text-author: - | text-type: - | assignment_quality: - | hoffmann_wetter_nr: - | library: - | library-shelfmark: - | date: - | place: - | text-place: - | printer: - | edition: - | literature: - | size: - | language: fnhd | corpus: ReF.BO | notes-transcription: - | abbr_ddd: - | extent: FnhdC: -; compl: - | extent-size: FnhdC: -; compl: -'),
])
def reference_headers(df: DataFrame) -> DataFrame:
    """Headers rewritten for the reference corpus, with notes and abbreviations looked up by their sigle."""
    spark = df.sparkSession
    notes = spark.createDataFrame([("F019", " a note "), ("F123", "other")], "sigle string, note string")
    short = spark.createDataFrame([("ABC", "F019")], "abbreviation string, sigle string")

    def made(t: DataFrame) -> DataFrame:
        docs = t.select("given", F.col("given").alias("doc_key"), F.col("given").alias("header_string"))
        return headers.reference_header(docs, notes, short).select("given", F.replace("header_string", F.lit("\n"), F.lit(" | ")).alias("header"))

    return once(df, made)


@golden("note missing", [
    ('F019x', 'n1', 'false'),
    ('G1', 'n2', 'false'),
    ('F019', 'n1', 'false'),
    ('H', '-', 'true'),
    ('G12345', '-', 'true'),
])
def looked_up_notes(df: DataFrame) -> DataFrame:
    """Notes by the beginning of the sigle; what the table lacks is told."""
    table = df.sparkSession.createDataFrame([("F019", "n1"), ("G1", "n2")], "sigle string, note string")
    met = headers.looked_up(df.withColumnRenamed("given", "sigle"), table, "note")
    return met.select("doc_id", F.coalesce("note", F.lit("-")).alias("note"), F.col("missing").cast("string").alias("missing"))


@golden("tags flags", [
    ('pos=VVFIN<VV;lemma=gehen [G123];morph=3.Sg.Pres.Ind.*', 'annoType=man;lemma=gehen;lemmaId=[G123];lemmaURL=http://www.woerterbuchnetz.de/DWB?lemid=G123;morph=3.Sg.Pres.Ind.Unr;pos=VVFIN;posLemma=VV', "<a href='http://www.woerterbuchnetz.de/DWB?lemid=G123'>G123</a>"),
    ('pos=NN;lemma=haus', 'annoType=man;lemma=haus;lemmaURL=http://www.woerterbuchnetz.de/DWB?lemma=haus;pos=NN', "<a href='http://www.woerterbuchnetz.de/DWB?lemma=haus'>haus</a>"),
    ('pos=VAFIN;lemma=sein;morph=3.Sg.Pres.Ind.*', 'annoType=man;lemma=sein;lemmaURL=http://www.woerterbuchnetz.de/DWB?lemma=sein;morph=3.Sg.Pres.Ind.Unr;pos=VAFIN', "<a href='http://www.woerterbuchnetz.de/DWB?lemma=sein'>sein</a>"),
    ('pos=VMFIN<VM;lemma=müssen [M1];morph=a.b.c.d.e', 'annoType=man;lemma=müssen;lemmaId=[M1];lemmaURL=http://www.woerterbuchnetz.de/DWB?lemid=M1;morph=a.b.c.d.e;pos=VMFIN;posLemma=VM', "<a href='http://www.woerterbuchnetz.de/DWB?lemid=M1'>M1</a>"),
    ('pos=VVFIN;lemma=machen;morph=a.b.c.d.*', 'annoType=man;lemma=machen;lemmaURL=http://www.woerterbuchnetz.de/DWB?lemma=machen;morph=a.b.c.d.*;pos=VVFIN', "<a href='http://www.woerterbuchnetz.de/DWB?lemma=machen'>machen</a>"),
    ('pos=VVFIN;lemma=tun;morph=a.b.c.*', 'annoType=man;lemma=tun;lemmaURL=http://www.woerterbuchnetz.de/DWB?lemma=tun;morph=a.b.c.*;pos=VVFIN', "<a href='http://www.woerterbuchnetz.de/DWB?lemma=tun'>tun</a>"),
    ('pos=ADV', 'annoType=man;pos=ADV', '-'),
    ('pos= A < B < C ;lemma=x [Y1] z', 'annoType=man;lemma=x;lemmaId=[Y1];lemmaURL=http://www.woerterbuchnetz.de/DWB?lemid=Y1;pos=A;posLemma=B', "<a href='http://www.woerterbuchnetz.de/DWB?lemid=Y1'>Y1</a>"),
])
def reference_tags(df: DataFrame) -> DataFrame:
    """The reference corpus's changes of one anno's tags, each way of addresses and irregular verbs."""
    pairs = F.transform(F.split("given", ";"), lambda p: F.struct(F.split_part(p, F.lit("="), F.lit(1)).alias("k"), F.split_part(p, F.lit("="), F.lit(2)).alias("v")))
    rows = df.select("doc_id", F.map_from_entries(pairs).alias("tags"), (F.col("doc_id") >= 0).alias("checked"))
    linked = modify.ref_postprocess(rows, link=True).select("doc_id", modify.get(F.col("tags"), "lemmaURL").alias("flags"))
    return modify.ref_postprocess(rows).select("doc_id", shown(F.col("tags")).alias("tags")).join(linked, "doc_id").withColumn("flags", F.coalesce("flags", F.lit("-")))
