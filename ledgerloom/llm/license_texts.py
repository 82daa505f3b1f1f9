"""Paragraphs of licences, as (licence, kind of its terms, paragraph).

At equal coefficients the first template wins: what only one version of a licence says comes before what several share.
"""

from __future__ import annotations

_BSD_GRANT = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the"
    " following conditions are met:"
)
_BSD_SOURCE = (
    "Redistributions of source code must retain the above copyright notice, this list of conditions and the following"
    " disclaimer."
)
_BSD_BINARY = (
    "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following"
    " disclaimer in the documentation and/or other materials provided with the distribution."
)
_BSD_NAMES = (
    "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products"
    " derived from this software without specific prior written permission."
)
_BSD_DISCLAIMER = (
    "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES,"
    " INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE"
    " DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL,"
    " SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR"
    " SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY,"
    " WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE"
    " OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_GNU_NOTICE = (
    "This {thing} is free software{mark} you can redistribute it and/or modify it under the terms of the GNU {kind} Public"
    " License as published by the Free Software Foundation{mark} either version {version} of the License, or (at your"
    " option) any later version."
)
_GNU_WARRANTY = (
    "This {thing} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied"
    " warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {kind} Public License for more details."
)
_GNU_COPY = (
    "You should have received a copy of the GNU {kind} Public License along with this {thing}. If not, see"
    " <https://www.gnu.org/licenses/>."
)
_GNU_NO_WARRANTY = (
    "THERE IS NO WARRANTY FOR THE PROGRAM, TO THE EXTENT PERMITTED BY APPLICABLE LAW. EXCEPT WHEN OTHERWISE STATED IN"
    " WRITING THE COPYRIGHT HOLDERS AND/OR OTHER PARTIES PROVIDE THE PROGRAM \"AS IS\" WITHOUT WARRANTY OF ANY KIND, EITHER"
    " EXPRESSED OR IMPLIED, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A"
    " PARTICULAR PURPOSE. THE ENTIRE RISK AS TO THE QUALITY AND PERFORMANCE OF THE PROGRAM IS WITH YOU. SHOULD THE PROGRAM"
    " PROVE DEFECTIVE, YOU ASSUME THE COST OF ALL NECESSARY SERVICING, REPAIR OR CORRECTION."
)
_GNU_DAMAGES = (
    "IN NO EVENT UNLESS REQUIRED BY APPLICABLE LAW OR AGREED TO IN WRITING WILL ANY COPYRIGHT HOLDER, OR ANY OTHER PARTY"
    " WHO {who} THE PROGRAM AS PERMITTED ABOVE, BE LIABLE TO YOU FOR DAMAGES, INCLUDING ANY GENERAL, SPECIAL, INCIDENTAL OR"
    " CONSEQUENTIAL DAMAGES ARISING OUT OF THE USE OR INABILITY TO USE THE PROGRAM (INCLUDING BUT NOT LIMITED TO LOSS OF"
    " DATA OR DATA BEING RENDERED INACCURATE OR LOSSES SUSTAINED BY YOU OR THIRD PARTIES OR A FAILURE OF THE PROGRAM TO"
    " OPERATE WITH ANY OTHER PROGRAMS), EVEN IF SUCH HOLDER OR OTHER PARTY HAS BEEN ADVISED OF THE POSSIBILITY OF SUCH"
    " DAMAGES."
)

_PARAGRAPHS: dict[tuple[str, str], tuple[str, ...]] = {
    ("MIT", "permissive"): (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated"
        " documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation"
        " the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to"
        " permit persons to whom the Software is furnished to do so, subject to the following conditions:",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of"
        " the Software.",
        "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO"
        " THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE"
        " AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT,"
        " TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE"
        " SOFTWARE.",
    ),
    ("BSD-3-Clause", "permissive"): (
        _BSD_NAMES, _BSD_GRANT, _BSD_SOURCE, _BSD_BINARY, _BSD_DISCLAIMER,
        f"{_BSD_GRANT} 1. {_BSD_SOURCE} 2. {_BSD_BINARY} 3. {_BSD_NAMES}",
    ),
    ("ISC", "permissive"): (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby"
        " granted, provided that the above copyright notice and this permission notice appear in all copies.",
        "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING"
        " ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL,"
        " DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS,"
        " WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE"
        " OR PERFORMANCE OF THIS SOFTWARE.",
    ),
    ("Apache-2.0", "permissive"): (
        "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance"
        " with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on"
        " an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the"
        " specific language governing permissions and limitations under the License.",
        "Grant of Copyright License. Subject to the terms and conditions of this License, each Contributor hereby grants to"
        " You a perpetual, worldwide, non-exclusive, no-charge, royalty-free, irrevocable copyright license to reproduce,"
        " prepare Derivative Works of, publicly display, publicly perform, sublicense, and distribute the Work and such"
        " Derivative Works in Source or Object form.",
        "Grant of Patent License. Subject to the terms and conditions of this License, each Contributor hereby grants to You"
        " a perpetual, worldwide, non-exclusive, no-charge, royalty-free, irrevocable (except as stated in this section)"
        " patent license to make, have made, use, offer to sell, sell, import, and otherwise transfer the Work, where such"
        " license applies only to those patent claims licensable by such Contributor that are necessarily infringed by their"
        " Contribution(s) alone or by combination of their Contribution(s) with the Work to which such Contribution(s) was"
        " submitted. If You institute patent litigation against any entity (including a cross-claim or counterclaim in a"
        " lawsuit) alleging that the Work or a Contribution incorporated within the Work constitutes direct or contributory"
        " patent infringement, then any patent licenses granted to You under this License for that Work shall terminate as of"
        " the date such litigation is filed.",
        "Redistribution. You may reproduce and distribute copies of the Work or Derivative Works thereof in any medium, with"
        " or without modifications, and in Source or Object form, provided that You meet the following conditions:",
        "Submission of Contributions. Unless You explicitly state otherwise, any Contribution intentionally submitted for"
        " inclusion in the Work by You to the Licensor shall be under the terms and conditions of this License, without any"
        " additional terms or conditions. Notwithstanding the above, nothing herein shall supersede or modify the terms of any"
        " separate license agreement you may have executed with Licensor regarding such Contributions.",
        "Trademarks. This License does not grant permission to use the trade names, trademarks, service marks, or product"
        " names of the Licensor, except as required for reasonable and customary use in describing the origin of the Work and"
        " reproducing the content of the NOTICE file.",
        "Disclaimer of Warranty. Unless required by applicable law or agreed to in writing, Licensor provides the Work (and"
        " each Contributor provides its Contributions) on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND,"
        " either express or implied, including, without limitation, any warranties or conditions of TITLE, NON-INFRINGEMENT,"
        " MERCHANTABILITY, or FITNESS FOR A PARTICULAR PURPOSE. You are solely responsible for determining the appropriateness"
        " of using or redistributing the Work and assume any risks associated with Your exercise of permissions under this"
        " License.",
        "Limitation of Liability. In no event and under no legal theory, whether in tort (including negligence), contract, or"
        " otherwise, unless required by applicable law (such as deliberate and grossly negligent acts) or agreed to in"
        " writing, shall any Contributor be liable to You for damages, including any direct, indirect, special, incidental, or"
        " consequential damages of any character arising as a result of this License or out of the use or inability to use the"
        " Work (including but not limited to damages for loss of goodwill, work stoppage, computer failure or malfunction, or"
        " any and all other commercial damages or losses), even if such Contributor has been advised of the possibility of"
        " such damages.",
    ),
    ("LGPL-2.1", "copyleft"): (
        _GNU_NOTICE.format(thing="library", kind="Lesser General", mark=";", version="2.1"),
        _GNU_WARRANTY.format(thing="library", kind="Lesser General"),
    ),
    ("LGPL-3.0", "copyleft"): (_GNU_NOTICE.format(thing="library", kind="Lesser General", mark=";", version="3"),),
    ("AGPL-3.0", "copyleft"): (
        _GNU_NOTICE.format(thing="program", kind="Affero General", mark=",", version="3"),
        _GNU_WARRANTY.format(thing="program", kind="Affero General"),
        _GNU_COPY.format(thing="program", kind="Affero General"),
    ),
    ("GPL-2.0", "copyleft"): (
        _GNU_NOTICE.format(thing="program", kind="General", mark=";", version="2"),
        "You should have received a copy of the GNU General Public License along with this program; if not, write to the"
        " Free Software Foundation, Inc., 51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA.",
        "You may copy and distribute verbatim copies of the Program's source code as you receive it, in any medium, provided"
        " that you conspicuously and appropriately publish on each copy an appropriate copyright notice and disclaimer of"
        " warranty; keep intact all the notices that refer to this License and to the absence of any warranty; and give any"
        " other recipients of the Program a copy of this License along with the Program.",
        f"BECAUSE THE PROGRAM IS LICENSED FREE OF CHARGE, {_GNU_NO_WARRANTY}",
        _GNU_DAMAGES.format(who="MAY MODIFY AND/OR REDISTRIBUTE"),
    ),
    ("GPL-3.0", "copyleft"): (
        _GNU_NOTICE.format(thing="program", kind="General", mark=":", version="3"),
        _GNU_COPY.format(thing="program", kind="General"),
        "The GNU General Public License is a free, copyleft license for software and other kinds of works.",
        "All rights granted under this License are granted for the term of copyright on the Program, and are irrevocable"
        " provided the stated conditions are met. This License explicitly affirms your unlimited permission to run the"
        " unmodified Program. The output from running a covered work is covered by this License only if the output, given its"
        " content, constitutes a covered work.",
        "You may convey verbatim copies of the Program's source code as you receive it, in any medium, provided that you"
        " conspicuously and appropriately publish on each copy an appropriate copyright notice; keep intact all notices"
        " stating that this License and any non-permissive terms added in accord with section 7 apply to the code; keep intact"
        " all notices of the absence of any warranty; and give all recipients a copy of this License along with the Program.",
        f"Disclaimer of Warranty. {_GNU_NO_WARRANTY}",
        f"Limitation of Liability. {_GNU_DAMAGES.format(who='MODIFIES AND/OR CONVEYS')}",
        _GNU_WARRANTY.format(thing="program", kind="General"),
    ),
    ("MPL-2.0", "copyleft"): (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not"
        " distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
        "Each Contributor hereby grants You a world-wide, royalty-free, non-exclusive license: (a) under intellectual property"
        " rights (other than patent or trademark) Licensable by such Contributor to use, reproduce, make available, modify,"
        " display, perform, distribute, and otherwise exploit its Contributions, either on an unmodified basis, with"
        " Modifications, or as part of a Larger Work; and (b) under Patent Claims of such Contributor to make, use, sell,"
        " offer for sale, have made, import, and otherwise transfer either its Contributions or its Contributor Version.",
        "Covered Software is provided under this License on an \"as is\" basis, without warranty of any kind, either"
        " expressed, implied, or statutory, including, without limitation, warranties that the Covered Software is free of"
        " defects, merchantable, fit for a particular purpose or non-infringing. The entire risk as to the quality and"
        " performance of the Covered Software is with You. Should any Covered Software prove defective in any respect, You"
        " (not any Contributor) assume the cost of any necessary servicing, repair, or correction. This disclaimer of warranty"
        " constitutes an essential part of this License. No use of any Covered Software is authorized under this License"
        " except under this disclaimer.",
    ),
    ("Unlicense", "public domain"): (
        "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form"
        " or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
        "In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright"
        " interest in the software to the public domain. We make this dedication for the benefit of the public at large and to"
        " the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in"
        " perpetuity of all present and future rights to this software under copyright law.",
    ),
}

PARAGRAPHS: tuple[tuple[str, str, str], ...] = tuple(
    (name, terms, paragraph) for (name, terms), all_ in _PARAGRAPHS.items() for paragraph in all_
)

# The text without the third clause, which alone tells it from the other in one piece.
BSD_2 = ("BSD-2-Clause", "permissive", f"{_BSD_GRANT} 1. {_BSD_SOURCE} 2. {_BSD_BINARY} {_BSD_DISCLAIMER}")
